"""Row contracts: constraints compiled to one array of violations for each row.

A contract says what a row at the edge must be: which columns there are, of what
type and length, from which values, matching what, within which times.  All of it
is one column expression, so rows are checked where they are read.  Rows without
violations go on, normalised; the others go to a quarantine table with what was
wrong with them and all that was given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATIONS = "violations"


@dataclass(frozen=True)
class Field:
    """One column; lengths are in characters, ``pattern`` must match, ``check`` names what else may be wrong."""

    name: str
    kind: str = "string"
    required: bool = False
    shortest: int = 0
    longest: int | None = None
    pattern: str | None = None
    among: tuple[str, ...] | None = None
    default: object = None
    check: tuple[str, Callable[[Column], Column]] | None = None  # name of the violation, condition under which a value is fine
    normalised: Callable[[Column], Column] | None = None

    def violations(self, value: Column) -> list[Column]:
        """What is wrong with a value, each null where it isn't."""

        def wrong(what: str, condition: Column) -> Column:
            return F.when(F.coalesce(condition, F.lit(False)), F.lit(f"{self.name}: {what}"))

        out = [wrong("missing", value.isNull())] if self.required else []
        if self.shortest:
            out.append(wrong("too short", F.length(value) < self.shortest))
        if self.longest is not None:
            out.append(wrong("too long", F.length(value) > self.longest))
        if self.pattern:
            out.append(wrong("malformed", ~value.rlike(self.pattern)))
        if self.among:
            out.append(wrong("unknown value", ~value.isin(*self.among)))
        if self.check:
            out.append(wrong(self.check[0], ~self.check[1](value)))
        return out

    def value(self, column: Column) -> Column:
        """The column as it goes on."""
        out = column if self.default is None else F.coalesce(column, F.lit(self.default))
        return (self.normalised(out) if self.normalised else out).cast(self.kind)


@dataclass(frozen=True)
class Contract:
    fields: tuple[Field, ...]

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields)

    @property
    def schema(self) -> str:
        return ", ".join(f"`{f.name}` {f.kind}" for f in self.fields)

    def checked(self, rows: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
        """``rows`` with an array of violations; columns that they lack are null.

        Columns that are neither the contract's nor ``carried`` are a violation of every row
        that has a value there.
        """
        extra = [name for name in rows.columns if name not in (*self.names, *carried)]
        of = {f.name: F.col(f"`{f.name}`").try_cast(f.kind) if f.name in rows.columns else F.lit(None).cast(f.kind) for f in self.fields}
        found = [F.when(F.col(f"`{name}`").isNotNull(), F.lit(f"{name}: not in the contract")) for name in sorted(extra)]
        for f in self.fields:
            if f.name in rows.columns:
                found.append(F.when(F.col(f"`{f.name}`").isNotNull() & of[f.name].isNull(), F.lit(f"{f.name}: not {f.kind}")))
            found += f.violations(of[f.name])
        return rows.withColumn(VIOLATIONS, F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"))

    def good(self, checked: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
        """The rows without violations, normalised, with the contract's columns after the carried ones."""
        columns = [f.value(F.col(f"`{f.name}`").cast(f.kind)) if f.name in checked.columns else f.value(F.lit(None).cast(f.kind)) for f in self.fields]
        return checked.filter(F.size(VIOLATIONS) == 0).select(*carried, *(c.alias(f.name) for c, f in zip(columns, self.fields)))

    def quarantined(self, checked: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
        """The other rows: what was carried, what was wrong, and all that was given, as JSON."""
        given = [name for name in checked.columns if name != VIOLATIONS]
        return checked.filter(F.size(VIOLATIONS) > 0).select(*carried, VIOLATIONS, F.to_json(F.struct(*(F.col(f"`{name}`") for name in given))).alias("given"))

    def of_json(self, records: DataFrame, value: str = "value", carried: tuple[str, ...] = ()) -> DataFrame:
        """Records of JSON text as rows to be checked, with every key of theirs a column of its type or a violation.

        Keys beyond the contract are found by name; a record that isn't an object, or
        that has a value of another type, keeps its text in ``given``.
        """
        text = F.col(f"`{value}`")
        parsed = F.from_json(text, f"{self.schema}, _wrong string", {"columnNameOfCorruptRecord": "_wrong"})
        rows = records.select(*carried, text.alias("_given"), parsed.alias("_p"), F.array_sort(F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), F.array(*map(F.lit, self.names)))).alias("_extra"))
        fields = rows.select(*carried, "_given", "_extra", F.col("_p._wrong").alias("_wrong"), F.col("_p").isNull().alias("_none"), *(F.col(f"_p.`{name}`").alias(name) for name in self.names))
        checked = self.checked(fields, (*carried, "_given", "_extra", "_wrong", "_none"))
        unread = F.when(F.col("_none") | F.col("_wrong").isNotNull(), F.array(F.lit("record: malformed"))).otherwise(F.array().cast("array<string>"))
        extra = F.transform("_extra", lambda name: F.concat(name, F.lit(": not in the contract")))
        return checked.withColumn(VIOLATIONS, F.concat(unread, extra, VIOLATIONS)).drop("_extra", "_wrong", "_none")


# Kinds of employment and bands of seniority that a posting can have.
EMPLOYMENT = ("full_time", "part_time", "contract", "internship", "temporary", "unknown")
BANDS = ("intern", "entry", "mid", "senior", "staff", "principal", "manager", "director", "executive", "unknown")

#: A posting as a scan hands it on; the limits are fixed values.
POSTING = Contract((
    Field("external_id", required=True, shortest=1, longest=256),
    Field("url", required=True, longest=2083, pattern=r"(?i)^https?://[^/?#\s]+([/?#]\S*)?$"),
    Field("title", required=True, shortest=1, longest=512),
    Field("description_html"),
    Field("description_text", required=True, shortest=1),
    Field("department"),
    Field("location_raw"),
    Field("location_city"),
    Field("location_country", pattern=r"^\p{L}{2}$", normalised=F.upper),
    Field("is_remote", "boolean", default=False),
    Field("employment_type", among=EMPLOYMENT, default="unknown"),
    Field("seniority_guess", among=BANDS, default="unknown"),
    Field("posted_at", "timestamp", check=("out of time", lambda at: F.year(at).between(2000, 2100))),
    Field("raw", default="{}"),
))
