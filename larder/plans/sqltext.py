"""SQL text builders for the oracle statements (DuckDB dialect)."""

from __future__ import annotations

from larder.functions import rules
from larder.functions.common import words_regex
from larder.plans.registry import sql_case, sql_round

__all__ = ["sql_case", "sql_round"]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(expr: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to)}, {q(flags)})"


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


def squeeze(expr: str) -> str:
    return f"trim({sub(expr, chr(92) + 's+', ' ')})"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def blank_null(expr: str) -> str:
    return f"CASE WHEN lower(trim({expr})) NOT IN ('', 'nan', 'none', '<na>') THEN trim({expr}) END"


def unit_key(expr: str) -> str:
    u = f"lower({blank_null(expr)})"
    return f"CASE WHEN {expr} IS NULL THEN NULL ELSE {sql_case(u, rules.UNIT_SPELLINGS, u)} END"


_NUM = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_FRAC = r"^(\d+)\s*/\s*(\d+)$"
_MIX = r"^(\d+)[\s\-]+(\d+)\s*/\s*(\d+)$"


def quantity_value(expr: str) -> str:
    t = f"({blank_null(expr)})"

    def g(p: str, n: int) -> str:
        return f"CAST(nullif(regexp_extract({t}, {q(p)}, {n}), '') AS DOUBLE)"

    return (
        f"CASE WHEN {t} = '11/2' THEN 1.5 WHEN {t} = '21/2' THEN 2.5 WHEN {t} = '11/4' THEN 1.25 "
        f"WHEN {has(t, _NUM)} THEN CASE WHEN TRY_CAST({t} AS DOUBLE) >= 0 THEN TRY_CAST({t} AS DOUBLE) END "
        f"WHEN {has(t, _FRAC)} THEN {g(_FRAC, 1)} / nullif({g(_FRAC, 2)}, 0) "
        f"WHEN {has(t, _MIX)} THEN {g(_MIX, 1)} + {g(_MIX, 2)} / nullif({g(_MIX, 3)}, 0) END"
    )


def quantity_status(expr: str) -> str:
    t = f"({blank_null(expr)})"
    v = f"({quantity_value(expr)})"
    return (
        f"CASE WHEN {t} IS NULL THEN 'MISSING_QUANTITY' WHEN {t} IN ('11/2', '21/2', '11/4') THEN 'PARSED_ANOMALY' "
        f"WHEN {v} IS NULL THEN 'PARSE_ERROR' WHEN {has(t, _NUM)} THEN 'PARSED_NUMERIC' "
        f"WHEN {has(t, _FRAC)} THEN 'PARSED_FRACTION' ELSE 'PARSED_MIXED_FRACTION' END"
    )


def clean_title(expr: str) -> str:
    t = squeeze(f"coalesce({expr}, '')")
    p = "(?i)" + "|".join(f"(?:{x})" for x in rules.TITLE_SPONSOR_PATTERNS)
    cut = f"trim({sub(t, p)})"
    tail = sub(cut, r"\s+-\s*$")
    return f"CASE WHEN {has(t, p)} THEN {squeeze(tail)} ELSE {t} END"


_UNITS = words_regex(list(rules.UNIT_SPELLINGS), boundary=False)
_PREFIX = f"^{rules.LEADING_RANGE}{rules.LEADING_NUMBER}" + r"\s*(?:" + _UNITS + r"\b\s*)?"


def phrase_key(expr: str) -> str:
    """Ingredient phrase key of ASCII text, as one scalar subquery."""
    plural = sql_case("t", rules.CONTROLLED_PLURALS, "t")
    protected = in_list(rules.PROTECTED_PHRASES)
    bare = sub(squeeze(sub("k0", r"\([^)]*\)")), r"^[^a-z0-9]+|[^a-z0-9]+$")
    return (
        f"(SELECT CASE WHEN k0 IN {protected} THEN k0 ELSE array_to_string(list_transform(string_split({squeeze('k5')}, ' '), lambda t: {plural}), ' ') END FROM "
        f"(SELECT k0, CASE WHEN k4 IN {protected} THEN k4 ELSE trim({sub('k4', '^organic ')}) END AS k5 FROM "
        f"(SELECT k0, CASE WHEN k3 IN {protected} THEN k3 ELSE trim({sub('k3', '^raw ')}) END AS k4 FROM "
        f"(SELECT k0, CASE WHEN k2 IN {protected} THEN k2 ELSE trim({sub('k2', '^fresh ')}) END AS k3 FROM "
        f"(SELECT k0, CASE WHEN k1 NOT IN {protected} AND trim({sub('k1', _PREFIX)}) <> '' THEN trim({sub('k1', _PREFIX)}) ELSE k1 END AS k2 FROM "
        f"(SELECT k0, {bare} AS k1 FROM (SELECT lower({squeeze(f'coalesce({expr}, {q(str())})')}) AS k0))))))))".replace("))))))))", ")))))))")
    )


def clean_context(expr: str) -> str:
    t = f"lower(trim(coalesce({expr}, '')))"
    for pattern, to in rules.CONTEXT_CLEANERS:
        t = sub(t, pattern, to)
    return t


def any_of(expr: str, words: list[str]) -> str:
    return has(expr, words_regex(words, boundary=False))


_NV = "|".join(p for p in rules.NON_VEG_PATTERNS if not p.startswith(r"\bturkey"))


def non_veg_from(low: str, cleaned: str) -> str:
    """Non-vegetarian term, given columns holding lower-cased and context-cleaned text."""
    turkey = sub(cleaned, r"\bturkey\s+(berry|chutney)", " ")
    guards = " ".join(
        f"WHEN {has(cleaned, p)} AND NOT {any_of(cleaned, ex)} THEN {q(term)}" for term, p, ex in rules.GUARDED_NON_VEG
    )
    return (
        f"CASE WHEN {any_of(low, rules.EGGPLANT_WORDS)} AND NOT {any_of(sub(low, rules.EGGPLANT_PATTERN, ' '), rules.EGGPLANT_OVERRIDES)} THEN NULL "
        f"WHEN {has(turkey, _NV + '|' + chr(92) + 'bturkey' + chr(92) + 'b')} THEN regexp_extract({turkey}, {q(_NV + '|' + chr(92) + 'bturkey' + chr(92) + 'b')}) {guards} END"
    )


def listed_from(cleaned: str, names: list[str]) -> str:
    arms = []
    for n in names:
        cond = has(cleaned, rf"\b{n}\b")
        if n in rules.PLANT_EXCEPTIONS:
            cond += f" AND NOT {any_of(cleaned, rules.PLANT_EXCEPTIONS[n])}"
        arms.append(f"WHEN {cond} THEN {q(n)}")
    return "CASE " + " ".join(arms) + " END"


def detectors(source: str, column: str, keep: str) -> str:
    """Relation ``keep, low, ctx, nonveg, nonvegan, satvik, jain, dairy`` over ``source.column``."""
    return (
        f"SELECT {keep}, low, ctx, {non_veg_from('low', 'ctx')} AS nonveg, "
        f"coalesce({non_veg_from('ctx', 'ctx2')}, {listed_from('ctx', rules.NON_VEGAN_NAMES)}) AS nonvegan, "
        f"{listed_from('ctx', rules.SATVIK_PROHIBITED)} AS satvik, {listed_from('ctx', rules.JAIN_PROHIBITED)} AS jain, "
        f"{listed_from('low', rules.DAIRY_NAMES)} IS NOT NULL AS dairy FROM "
        f"(SELECT *, {clean_context('ctx')} AS ctx2 FROM (SELECT *, lower(trim(coalesce({column}, ''))) AS low, {clean_context(column)} AS ctx FROM {source}))"
    )


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {q('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]{2,}')})"


def food_tokens(expr: str) -> str:
    syn = sql_case("t", rules.FOOD_TOKEN_SYNONYMS, "t")
    pat = q("[" + chr(92) + "p{L}" + chr(92) + "p{N}]+")
    return f"list_transform(regexp_extract_all(lower({expr}), {pat}), lambda t: {syn})"
