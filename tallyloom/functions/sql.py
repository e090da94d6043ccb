"""The engine's column functions under names that SQL can call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallyloom.plans.bindings import FIELDS, WEIGHTS

from . import failures, text


def quoted(pattern: str) -> str:
    """A raw SQL string literal."""
    return f"r'{pattern}'" if "'" not in pattern else f'r"{pattern}"'


def words(values) -> str:
    return ", ".join('"' + v + '"' for v in values)


def definitions() -> dict[str, str]:
    """name(parameters) RETURNS type -> body."""
    kinds = []
    for pattern, label in failures.ERROR_KINDS:
        a, code, b = label.partition("{}")
        told = f"concat('{a}', regexp_extract(m, {quoted('(?i)' + pattern)}, 0), '{b}')" if code else "'" + label + "'"
        kinds.append(f"WHEN m RLIKE {quoted('(?i)' + pattern)} THEN {told}")
    key = "lower(coalesce(name, ''))"
    for pattern, new in text.KEY_STEPS:
        key = f"regexp_replace({key}, {quoted(pattern)}, '{new}')"
    low = "w"
    for old, new in text.LOWERED:
        low = f"replace({low}, '{old}', '{new}')"
    low = f"regexp_replace(lower({low}), \"'s$\", '')"
    telling = (
        rf"NOT array_contains(array({words(dict.fromkeys([*text.COMMON_WORDS, *text.COMMON_SHORT]))}), {low}) AND ((w RLIKE {quoted(text.CAPITALISED)} AND length({low}) >= 3) OR length({low}) >= 4 OR {low} IN ({words(text.COLOURS)}))"
    )
    number = text.JAVA_NUMBER.replace(r'\"', r"\x22")
    weights = "map(" + ", ".join(f"'{f}', {WEIGHTS[f]}D" for f in FIELDS) + ")"
    present = f"filter(transform(array({', '.join(repr(f) for f in FIELDS)}), f -> named_struct('s', CAST(scores[f] AS DOUBLE), 'w', {weights}[f])), x -> x.s IS NOT NULL)"
    total = lambda e: f"aggregate({present}, 0.0D, (a, x) -> a + {e})"
    weighed = f"filter(transform(array({', '.join(repr(f) for f in FIELDS)}), f -> named_struct('s', CAST(scores[f] AS DOUBLE), 'w', coalesce(CAST(weights[f] AS DOUBLE), 0.0D))), x -> x.s IS NOT NULL)"
    summed = lambda e: f"aggregate({weighed}, 0.0D, (a, x) -> a + {e})"
    rounded = lambda x: f"floor({x} * 10 + 0.5D) / 10.0D"
    return {
        "token_estimate(t STRING) RETURNS BIGINT": "ceil(length(coalesce(t, '')) / 4)",
        "error_kind(m STRING) RETURNS STRING": f"CASE {' '.join(kinds)} ELSE 'Other' END",
        "dedupe_key(name STRING) RETURNS STRING": key,
        "detail_terms(t STRING) RETURNS ARRAY<STRING>": f"""array_sort(array_distinct(concat(transform(regexp_extract_all(coalesce(t, ''), {quoted(number)}, 0), x -> regexp_replace(lower(x), r'\\s+', ' ')),
            transform(filter(regexp_extract_all(coalesce(t, ''), {quoted(text.WORD)}, 0), w -> {telling}), w -> {low}))))""",
        "weighted_overall(scores MAP<STRING, INT>) RETURNS DOUBLE": f"CASE WHEN {total('x.w')} > 0 THEN {rounded(total('x.s * x.w') + ' / ' + total('x.w'))} WHEN size({present}) > 0 THEN {rounded(total('x.s') + f' / size({present})')} END",
        "weighted_overall_by(scores MAP<STRING, INT>, weights MAP<STRING, DOUBLE>) RETURNS DOUBLE": f"CASE WHEN {summed('x.w')} > 0 THEN {rounded(summed('x.s * x.w') + ' / ' + summed('x.w'))} WHEN size({weighed}) > 0 THEN {rounded(summed('x.s') + f' / size({weighed})')} END",
    }


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; their names."""
    for head, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.partition("(")[0] for head in definitions()]
