"""Porter's stemmer as SQL: an implementation of its own, by measures as patterns, that the library's is held against."""

from __future__ import annotations

from ragspark.functions.stem import STEP_2, STEP_3, STEP_4

#: A run of consonants and of vowels; y is a vowel after a consonant.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: At least one and two sequences of vowels and consonants, just one, a vowel, and consonants, vowel and consonant alone.
OVER_0, OVER_1, JUST_1 = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$"
VOWEL, CVC = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"


def _is(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _cut(n: int) -> str:
    """x without its last n characters."""
    return f"left(x, length(x) - {n})"


def _suffixes(rules: dict[str, str], test: str) -> str:
    """The rule of the longest suffix alone."""
    ordered = sorted(rules, key=len, reverse=True)
    cases = " ".join(f"WHEN suffix(x, '{s}') THEN CASE WHEN {_is(_cut(len(s)), test)} THEN {_cut(len(s))} || '{rules[s]}' ELSE x END" for s in ordered)
    return f"CASE {cases} ELSE x END"


def stems_sql(vocabulary: str, prefix: str = "") -> str:
    """Common table expressions that end in {prefix}stems (w, s): each word of a query of words (w) with its stem."""
    p = prefix
    double = "right(x, 1) = substr(x, length(x) - 1, 1) AND right(x, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z')"
    ends = {s: "" for s in STEP_4}
    four = " ".join(f"WHEN suffix(x, '{s}') THEN CASE WHEN {_is(_cut(len(s)), OVER_1)}{f' AND right({_cut(3)}, 1) IN (chr(115), chr(116))' if s == 'ion' else ''} THEN {_cut(len(s))} ELSE x END" for s in sorted(ends, key=len, reverse=True))
    steps = (
        f"CASE WHEN suffix(x, 'sses') OR suffix(x, 'ies') THEN {_cut(2)} WHEN suffix(x, 'ss') THEN x WHEN suffix(x, 's') THEN {_cut(1)} ELSE x END",
        # what ed and ing are taken from is marked, as it alone is mended
        f"CASE WHEN suffix(x, 'eed') THEN CASE WHEN {_is(_cut(3), OVER_0)} THEN {_cut(1)} ELSE x END WHEN suffix(x, 'ed') AND {_is(_cut(2), VOWEL)} THEN {_cut(2)} || '*' WHEN suffix(x, 'ing') AND {_is(_cut(3), VOWEL)} THEN {_cut(3)} || '*' ELSE x END",
        f"CASE WHEN NOT suffix(x, '*') THEN x ELSE (SELECT CASE WHEN suffix(x, 'at') OR suffix(x, 'bl') OR suffix(x, 'iz') THEN x || 'e' WHEN {double} THEN {_cut(1)} WHEN {_is('x', JUST_1)} AND {_is('x', CVC)} THEN x || 'e' ELSE x END FROM (SELECT left(o.x, length(o.x) - 1) AS x)) END",
        f"CASE WHEN suffix(x, 'y') AND {_is(_cut(1), VOWEL)} THEN {_cut(1)} || 'i' ELSE x END",
        _suffixes(STEP_2, OVER_0), _suffixes(STEP_3, OVER_0), f"CASE {four} ELSE x END",
        f"CASE WHEN suffix(x, 'e') AND ({_is(_cut(1), OVER_1)} OR {_is(_cut(1), JUST_1)} AND NOT {_is(_cut(1), CVC)}) THEN {_cut(1)} ELSE x END",
        f"CASE WHEN suffix(x, 'll') AND {_is('x', OVER_1)} THEN {_cut(1)} ELSE x END",
    )
    # a first y is a consonant
    out = [f"{p}st0 AS (SELECT w, CASE WHEN left(w, 1) = 'y' THEN 'Y' || substr(w, 2) ELSE w END AS x FROM (SELECT DISTINCT w FROM ({vocabulary})) WHERE length(w) BETWEEN 3 AND 64)"]
    out += [f"{p}st{k + 1} AS (SELECT w, {step} AS x FROM {p}st{k} o)" for k, step in enumerate(steps)]
    out.append(f"{p}stems AS (SELECT w, CASE WHEN left(x, 1) = 'Y' THEN 'y' || substr(x, 2) ELSE x END AS s FROM {p}st{len(steps)} UNION ALL SELECT DISTINCT w, w FROM ({vocabulary}) WHERE length(w) NOT BETWEEN 3 AND 64)")
    return ",\n ".join(out)
