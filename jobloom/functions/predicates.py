"""Column predicates of ledger reads: scopes, filters, cursors, windows of time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_PER_PAGE = 1000


@dataclass(frozen=True)
class Scope:
    """Which tenants' rows a read sees: one organization's, those of none ("global"), or all ("admin")."""

    kind: str
    organization: int | str | None = None

    @classmethod
    def admin(cls) -> Scope:
        return cls("admin")

    @classmethod
    def tenantless(cls) -> Scope:
        return cls("global")

    @classmethod
    def of(cls, organization: int | str) -> Scope:
        return cls("organization", organization)

    @classmethod
    def from_legacy(cls, organization: int | str | None) -> Scope:
        """The older form, in which no organization means all rows, not the global ones."""
        return cls.admin() if organization is None else cls.of(organization)

    def sees(self, column: str = "organization_id") -> Column:
        """The predicate of a read."""
        if self.kind == "admin":
            return F.lit(True)
        return F.col(column).isNull() if self.kind == "global" else F.col(column) == self.organization

    def exactly(self, column: str = "organization_id") -> Column:
        """The predicate of a lookup by key, which has no scope over all tenants."""
        if self.kind == "admin":
            raise ValueError("a key belongs to one organization or to none")
        return self.sees(column)


def instant(text: str) -> Column:
    """An instant without zone."""
    return F.to_timestamp_ntz(F.lit(text))


def matches(column: str, text: str | None) -> Column:
    """Case-insensitive substring search in which % and _ keep their meaning; all rows without a text."""
    return F.lit(True) if text is None else F.col(column).ilike(f"%{text}%")


def contains_text(column: str, text: str | None) -> Column:
    """Case-insensitive substring search for the text as it stands; all rows without a text."""
    return F.lit(True) if text is None else F.contains(F.lower(column), F.lower(F.lit(text)))


def equals(column: str, value: object | None) -> Column:
    """Equality where a value is given."""
    return F.lit(True) if value is None else F.col(column) == value


def among(column: str, values: list) -> Column:
    """Set membership; an empty set has no member."""
    return F.col(column).isin(values) if values else F.lit(False)


def before_cursor(created_at: str, row_id: int) -> Column:
    """Rows strictly after the cursor in the order newest first, by (created_at, id).

    The first condition follows from the second; it alone can be pushed to a scan.
    """
    at = instant(created_at)
    return (F.col("created_at") <= at) & (F.struct("created_at", "id") < F.struct(at.alias("created_at"), F.lit(row_id).cast("long").alias("id")))


def due(as_of: str, column: str = "next_run_at") -> Column:
    return F.col(column) <= instant(as_of)


def expired(as_of: str, column: str = "lease_expires_at") -> Column:
    return F.col(column) < instant(as_of)


def last_day(as_of: str, column: str) -> Column:
    """Within 24 hours before the instant, or later."""
    return F.col(column) >= instant(as_of) - F.expr("INTERVAL '24' HOUR")


def json_is(column: str, path: str, value: str) -> Column:
    return F.get_json_object(column, path) == value


def any_field_contains(text: str, *columns: str) -> Column:
    """Search over displayed fields."""
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(name).cast("string")), F.lit(text.lower())), F.lit(False))
    return found


def check_page(limit: int, offset: int = 0) -> None:
    if not 1 <= limit <= MOST_PER_PAGE or offset < 0:
        raise ValueError(f"a page has 1 to {MOST_PER_PAGE} rows and an offset of at least 0")


def progress_percent(done: str = "progress_done", total: str = "progress_total") -> Column:
    """Progress in percent, to two places; null without a positive total."""
    return F.when(F.col(total) > 0, F.round(F.col(done).cast("decimal(20,0)") * 100 / F.col(total).cast("decimal(20,0)"), 2).cast("double"))


def continuation_is_valid(payload: str = "payload", run_number: str = "run_number") -> Column:
    """Whether a REQUEUED event's payload is one of a handler's continuation to the next run.

    Types are told from the JSON text itself: a number or a string of the wrong kind doesn't
    count. A payload without ``requeue_kind`` is of the older form; one with null isn't.
    """
    document = F.try_parse_json(payload)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(document, f"$.{name}", "variant"))
    text = lambda name: F.get_json_object(payload, f"$.{name}")
    number = lambda name: kind(name).isin("BIGINT") | kind(name).startswith("DECIMAL")
    keys = F.json_object_keys(payload)
    time = r"^[+-]?[0-9]+-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
    return F.coalesce(
        number("next_run_number")
        & text("next_run_number").rlike("^[1-9][0-9]*$")
        & (text("next_run_number").try_cast("long") == F.col(run_number).cast("long") + 1)
        & (text("next_run_number").try_cast("long") <= 2147483647)
        & (kind("next_run_at") == "STRING")
        & text("next_run_at").rlike(time)
        & text("next_run_at").try_cast("timestamp").isNotNull()
        & number("delay_microseconds")
        & text("delay_microseconds").rlike("^(0|[1-9][0-9]*)$")
        & text("delay_microseconds").try_cast("long").isNotNull()
        & (kind("reason") == "STRING")
        & (text("reason") == "HANDLER_CONTINUATION")
        & ((F.coalesce(kind("requeue_kind"), F.lit("")) == "STRING") & (text("requeue_kind") == "HANDLER_CONTINUATION") | ~F.array_contains(keys, "requeue_kind")),
        F.lit(False),
    )
