"""The Porter stemmer as SQL: a chain of common table expressions, a step each, over distinct tokens."""

from __future__ import annotations

from curatrix.functions.stem import STEP2, STEP3, STEP4

# A consonant and a vowel sequence; y is a vowel behind a consonant. A word's first y is written Y meanwhile.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_SOME, _ONE, _MORE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
_VOWEL, _SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"


def _has(word: str, pattern: str) -> str:
    return f"regexp_matches({word}, '{pattern}')"


def _less(n: int, word: str = "w") -> str:
    return f"left({word}, length({word}) - {n})"


def _table(pairs: list[tuple[str, str]], measure: str = _SOME) -> str:
    """The rule of the longest suffix alone, where the rest is long enough."""
    cases = "".join(f" WHEN suffix(w, '{end}') THEN CASE WHEN {_has(_less(len(end)), measure)} THEN {_less(len(end))} || '{new}' ELSE w END" for end, new in sorted(pairs, key=lambda x: -len(x[0])))
    return f"CASE{cases} ELSE w END"


def _without_suffix() -> str:
    """Step 4: the longest suffix goes where enough is left; ion only behind s or t."""
    cases = ""
    for end in sorted(STEP4, key=lambda x: -len(x)):
        rest = _less(len(end))
        ok = _has(rest, _MORE) + (f" AND {_has(rest, '[st]$')}" if end == "ion" else "")
        cases += f" WHEN suffix(w, '{end}') THEN CASE WHEN {ok} THEN {rest} ELSE w END"
    return f"CASE{cases} ELSE w END"


def stems(tokens: str) -> str:
    """Common table expressions that end in ``stems`` (token, stem), of the table ``tokens`` (token)."""
    ends = lambda *xs: "(" + " OR ".join(f"suffix(w, '{x}')" for x in xs) + ")"
    steps = [
        f"CASE WHEN {ends('sses', 'ies')} THEN {_less(2)} WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN {_less(1)} ELSE w END",
        # A mark behind the word says that an ending went, and that the next step mends the rest.
        f"CASE WHEN suffix(w, 'eed') THEN CASE WHEN {_has(_less(3), _SOME)} THEN {_less(1)} ELSE w END"
        f" WHEN suffix(w, 'ed') THEN CASE WHEN {_has(_less(2), _VOWEL)} THEN {_less(2)} || '#' ELSE w END"
        f" WHEN suffix(w, 'ing') THEN CASE WHEN {_has(_less(3), _VOWEL)} THEN {_less(3)} || '#' ELSE w END ELSE w END",
        f"CASE WHEN NOT suffix(w, '#') THEN w WHEN {ends('at#', 'bl#', 'iz#')} THEN {_less(1)} || 'e'"
        f" WHEN length(w) > 2 AND substr(w, -2, 1) = substr(w, -3, 1) AND {_has(_less(1), '[^aeiouylsz]$')} THEN {_less(2)}"
        f" WHEN {_has(_less(1), _ONE)} AND {_has(_less(1), _SHORT)} THEN {_less(1)} || 'e' ELSE {_less(1)} END",
        f"CASE WHEN suffix(w, 'y') AND {_has(_less(1), _VOWEL)} THEN {_less(1)} || 'i' ELSE w END",
        _table(STEP2),
        _table(STEP3),
        _without_suffix(),
        f"CASE WHEN suffix(w, 'e') AND ({_has(_less(1), _MORE)} OR {_has(_less(1), _ONE)} AND NOT {_has(_less(1), _SHORT)}) THEN {_less(1)} ELSE w END",
        f"CASE WHEN suffix(w, 'll') AND {_has(_less(1), _MORE)} THEN {_less(1)} ELSE w END",
    ]
    out = f"step0 AS (SELECT DISTINCT token, regexp_replace(token, '^y', 'Y') AS w, regexp_full_match(token, '[a-z]{{3,}}') AS plain FROM {tokens})"
    for i, s in enumerate(steps):
        out += f", step{i + 1} AS (SELECT token, plain, CASE WHEN plain THEN {s} ELSE w END AS w FROM step{i})"
    return out + f", stems AS (SELECT token, regexp_replace(w, '^Y', 'y') AS stem FROM step{len(steps)})"
