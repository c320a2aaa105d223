"""The contract of a report: what every table must hold, compiled to columns that tell what breaks it, and where.

A rule describes a value, the rules of its parts included: elements of a list, fields of a structure, values
of a map. :func:`breaches` turns a rule into one column, an array of the paths that break it and why; there is
no loop over rows and nothing is collected. A sound row has an empty array.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsight import fixed_values as fv

_BREACH = "array<struct<path:string,problem:string>>"


@dataclass(frozen=True)
class Rule:
    """What a value must be. Nothing is asked of an absent value that is not ``required``."""

    required: bool = False
    one_of: tuple | None = None
    least: float | None = None
    most: float | None = None
    pattern: str | None = None
    filled: bool = False
    unique: bool = False
    ordered: bool = False
    items: Rule | None = None
    fields: dict[str, Rule] = field(default_factory=dict)
    values: Rule | None = None
    rising: tuple[str, ...] = ()


def _step(path: Column, step: Column | str) -> Column:
    step = F.lit(step) if isinstance(step, str) else step
    return F.when(path == "", step).otherwise(F.concat(path, F.lit("."), step))


def breaches(rule: Rule, value: Column, path: Column) -> Column:
    """``array<struct<path, problem>>`` of what breaks a rule in a value found at a path."""

    def tell(test: Column, problem: str) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(problem).alias("problem"))))

    found = []
    if rule.required:
        found.append(tell(value.isNull(), "is missing"))
    if rule.one_of is not None:
        found.append(tell(~value.isin(*rule.one_of), "is not one of the known values"))
    if rule.least is not None:
        found.append(tell(value < rule.least, f"is less than {rule.least:g}"))
    if rule.most is not None:
        found.append(tell(value > rule.most, f"is more than {rule.most:g}"))
    if rule.pattern is not None:
        found.append(tell(~value.rlike(rule.pattern), "is not of the required form"))
    if rule.filled:
        found.append(tell(F.length(value) == 0 if rule.items is None else F.size(value) == 0, "is empty"))
    if rule.unique:
        found.append(tell(F.size(F.array_distinct(value)) < F.size(value), "repeats an element"))
    if rule.ordered:
        found.append(tell(value != F.array_sort(value), "is not in order"))
    for name, part in rule.fields.items():
        # Parts of an absent structure are not missing: the structure is, if it has to be there.
        inside = breaches(part, value[name], _step(path, name))
        found.append(F.when(value.isNotNull(), inside))
    for low, high in zip(rule.rising, rule.rising[1:]):
        found.append(tell(value[low] > value[high], f"has {low} above {high}"))
    if rule.items is not None:
        each = F.transform(value, lambda item, at: breaches(rule.items, item, F.concat(path, F.lit("["), at.cast("string"), F.lit("]"))))
        found.append(F.flatten(each))
    if rule.values is not None:
        each = F.transform(F.map_entries(value), lambda entry: breaches(rule.values, entry["value"], _step(path, entry["key"])))
        found.append(F.flatten(each))
    none = F.array().cast(_BREACH)
    return F.concat(none, *[F.coalesce(part.cast(_BREACH), none) for part in found])


#: What every row of a table may be known by, as far as the table has it.
NAMES = ("scan_id", "id", "method", "url_pattern", "side", "status", "kind", "name", "resource", "endpoint")


def violations(rows: DataFrame, table: str, rules: dict[str, Rule]) -> DataFrame:
    """``table, row, path, problem``: one row for every breach. A column that a rule names and the table lacks is one too."""
    named = F.to_json(F.struct(*[F.col(name) for name in NAMES if name in rows.columns]))
    lacking = sorted(set(rules) - set(rows.columns))
    found = [breaches(rule, F.col(name), F.lit(name)) for name, rule in rules.items() if name in rows.columns]
    of_rows = rows.select(F.lit(table).alias("table"), named.alias("row"), F.explode(F.concat(F.array().cast(_BREACH), *found)).alias("b"))
    told = of_rows.select("table", "row", "b.path", "b.problem")
    if not lacking:
        return told
    gone = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(name) for name in lacking])).alias("path"))
    return told.union(gone.select(F.lit(table), F.lit(None).cast("string"), "path", F.lit("the column is missing")))


_TEXT = Rule(required=True, filled=True)
_COUNT = Rule(required=True, least=1)
_KEY = {"scan_id": Rule(required=True), "method": Rule(required=True, pattern="^[A-Z]+$"), "url_pattern": Rule(required=True, pattern="^/")}
_GAP = Rule(one_of=tuple(fv.GAP_REASONS))
_PERCENTILE = Rule(required=True, least=0)
_PERCENTILES = Rule(fields={"p50": _PERCENTILE, "p95": _PERCENTILE, "max": _PERCENTILE}, rising=("p50", "p95", "max"))
_CATEGORY = Rule(required=True, one_of=tuple(fv.CATEGORIES))
_NAMES_LIST = Rule(required=True, items=_TEXT)

#: The rules of every table of a report.
CONTRACT: dict[str, dict[str, Rule]] = {
    "endpoints": {
        **_KEY,
        "id": _TEXT,
        "category": _CATEGORY,
        "count": _COUNT,
        "status_codes": Rule(required=True, unique=True, ordered=True, filled=True, items=Rule(required=True, least=0, most=599)),
        "request_headers": Rule(values=Rule(required=True)),
        "response_headers": Rule(values=Rule(required=True)),
        "request_gap": _GAP,
        "response_gap": _GAP,
        "path_params": Rule(required=True, unique=True, items=Rule(required=True, pattern="^[A-Za-z]")),
        "timing": _PERCENTILES,
        "request_bytes": _PERCENTILES,
        "response_bytes": _PERCENTILES,
    },
    "values": {**_KEY, "kind": Rule(required=True, one_of=("origin", "mime", "page")), "value": Rule(required=True), "calls": _COUNT},
    "params": {**_KEY, "name": _TEXT, "sample_values": Rule(required=True, items=Rule(required=True))},
    "shapes": {
        **_KEY,
        "side": Rule(required=True, pattern=r"^(request|response|error:[0-9]+)$"),
        "path": Rule(required=True, items=Rule(required=True)),
        "types": Rule(required=True, filled=True, unique=True, items=Rule(required=True, one_of=("any", "array", "boolean", "integer", "null", "number", "object", "string"))),
        "format": Rule(one_of=tuple(name for name, _ in fv.STRING_FORMATS)),
        "required": Rule(required=True),
        "enum": Rule(unique=True, ordered=True, items=_TEXT),
    },
    "errors": {**_KEY, "status": Rule(required=True, least=400, most=599), "count": _COUNT, "schema_reason": _GAP},
    "vendors": {**_KEY, "vendor": _TEXT, "vendor_category": _TEXT, "payload_keys": _NAMES_LIST},
    "operations": {**_KEY, "type": Rule(required=True, one_of=tuple(fv.GRAPHQL_OPERATIONS)), "name": Rule(filled=True), "selections": _NAMES_LIST, "arguments": _NAMES_LIST},
    "introspection": {**_KEY, "introspection": Rule(required=True)},
    "resources": {"scan_id": Rule(required=True), "resource": _TEXT, "categories": Rule(required=True, filled=True, items=_CATEGORY), "methods": Rule(required=True, filled=True, items=_TEXT), "missing_methods": _NAMES_LIST},
    "findings": {"scan_id": Rule(required=True), "kind": _TEXT, "severity": Rule(required=True, one_of=tuple(fv.SEVERITIES)), "title": _TEXT, "endpoint": Rule(filled=True)},
}


def report_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Every breach of the contract in the tables of a report; tables the contract does not know are passed over."""
    checked = [violations(rows, name, CONTRACT[name]) for name, rows in tables.items() if name in CONTRACT]
    found = checked[0]
    for more in checked[1:]:
        found = found.union(more)
    return found
