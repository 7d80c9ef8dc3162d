"""Planning cycles: sources, workbench, forecasts, orders, lock.

Operators answer for any number of cycles at once; ``cycle_id`` is part of
every key. A cycle's month is T, its horizon T to T+3, its stock baseline T-1.
Blank is never zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions.dates import month_offset, month_start
from stockweave.functions.numbers import forecast_valid, order_quantity
from stockweave.functions.text import blank_to_null
from stockweave.operators.groups import next_in_group
from stockweave.operators.planning_feeds import STORED_QTY

HORIZON = 4


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def baseline_month() -> Column:
    return month_offset("cycle_month", -1)


# --- sources ---------------------------------------------------------------


def binding_validity(bindings: DataFrame, versions: DataFrame) -> DataFrame:
    """Bindings with their version's type and ``binding_state``.

    A period starts and ends on a first day and lies inside the coverage.
    """
    known = versions.select(
        "dataset_version_id", "dataset_type", F.col("period_start").alias("coverage_start"), F.col("period_end").alias("coverage_end")
    )
    joined = bindings.join(known, "dataset_version_id", "left")
    first_days = (F.dayofmonth("period_start") == 1) & (F.dayofmonth("period_end") == 1)
    inside = (
        (F.col("coverage_start") <= F.col("period_start"))
        & (F.col("period_start") <= F.col("period_end"))
        & (F.col("period_end") <= F.col("coverage_end"))
    )
    state = (
        F.when(F.col("dataset_type").isNull(), "VERSION_MISSING")
        .when(F.coalesce(first_days & inside, F.lit(False)), "VALID")
        .otherwise("OUTSIDE_COVERAGE")
    )
    return joined.withColumn("binding_state", state)


def overlapping_months(bindings: DataFrame, versions: DataFrame, same_version_allowed: bool) -> DataFrame:
    """Months claimed twice per (cycle, dataset type).

    Periods are whole months, so an overlap is a month listed more than once:
    no pair of bindings is compared. Choosing sources rejects any overlap,
    locking only one between different versions.
    """
    types = versions.select("dataset_version_id", "dataset_type")
    months = (
        bindings.filter(F.col("period_start") <= F.col("period_end"))
        .join(types, "dataset_version_id")
        .withColumn("month", F.explode(F.expr("sequence(period_start, period_end, interval 1 month)")))
    )
    claims = months.groupBy("cycle_id", "dataset_type", "month").agg(
        F.count(F.lit(1)).alias("bindings"), F.min("dataset_version_id").alias("_a"), F.max("dataset_version_id").alias("_b")
    )
    clash = F.col("_a") != F.col("_b") if same_version_allowed else F.col("bindings") > 1
    return claims.filter(clash).drop("_a", "_b")


def baseline_states(cycles: DataFrame, bindings: DataFrame, versions: DataFrame) -> DataFrame:
    """Ready when exactly one valid inventory version covers T-1, else Missing or Conflict."""
    checked = binding_validity(bindings, versions).filter(F.col("dataset_type") == "INVENTORY")
    base = cycles.select("cycle_id", "cycle_month", baseline_month().alias("baseline_month"))
    covering = base.join(checked.select("cycle_id", "dataset_version_id", "period_start", "period_end", "binding_state"), "cycle_id").filter(
        F.col("baseline_month").between(F.col("period_start"), F.col("period_end"))
    )
    hits = covering.groupBy("cycle_id").agg(
        F.min("dataset_version_id").alias("_a"),
        F.max("dataset_version_id").alias("_b"),
        F.max(F.col("binding_state") != "VALID").alias("_invalid"),
    )
    joined = base.join(hits, "cycle_id", "left")
    state = (
        F.when(F.col("_a").isNull(), "Baseline Missing")
        .when(F.col("_invalid") | (F.col("_a") != F.col("_b")), "Baseline Conflict")
        .otherwise("Ready")
    )
    return joined.select(
        "cycle_id",
        "cycle_month",
        "baseline_month",
        state.alias("baseline_state"),
        F.when(state == "Ready", F.col("_a")).alias("baseline_version_id"),
    )


def openings(states: DataFrame, product_month: DataFrame) -> DataFrame:
    """Opening per product: the baseline month's ending, only when Ready."""
    fact = product_month.select(
        F.col("dataset_version_id").alias("baseline_version_id"),
        F.col("inventory_month").alias("baseline_month"),
        "product_id",
        F.col("ending_qty").alias("opening_qty"),
    )
    return (
        states.filter(F.col("baseline_state") == "Ready")
        .join(fact, ["baseline_version_id", "baseline_month"])
        .select("cycle_id", "product_id", "opening_qty")
    )


# --- supply, demand, projection --------------------------------------------


def incoming_buckets(cycles: DataFrame, lines: DataFrame) -> DataFrame:
    """Supply per product and cycle: T..T+3 by arrival month, unscheduled, overdue.

    Lines are reduced to months per snapshot and product, and each cycle sets a
    mark on the line of months of every product of its snapshot. A mark then
    sums the months n ahead of it and all months behind it: one sorted pass
    over months and marks, no month meets a cycle it does not count for. A
    window holds one row for each month and cycle of a snapshot's product.
    Supply beyond the horizon and entered lines are left out.
    """
    future = lines.filter(F.col("shipment_qty").isNotNull() & ~F.col("warehouse_entry_recorded"))
    key = ["incoming_snapshot_id", "product_id"]
    count = lambda month: F.year(month) * 12 + F.month(month)
    months = future.groupBy(*key, month_start("eta").alias("_eta")).agg(F.sum("shipment_qty").alias("qty"))
    products = months.select(*key).distinct()
    marks = cycles.select("cycle_id", "incoming_snapshot_id", count("cycle_month").alias("_at")).join(products, "incoming_snapshot_id")
    line = marks.select(*key, "_at", "cycle_id", F.lit(None).cast(months.schema["qty"].dataType).alias("qty")).unionByName(
        months.select(*key, count("_eta").alias("_at"), F.lit(None).cast(cycles.schema["cycle_id"].dataType).alias("cycle_id"), "qty")
    )
    all_months = Window.partitionBy(*key)
    along = all_months.orderBy("_at")

    def total(value: Column, window) -> Column:
        return F.coalesce(F.sum(value).over(window), F.lit(0)).cast(STORED_QTY)

    dated = F.when(F.col("_at").isNotNull(), F.col("qty"))
    sums = line.withColumns(
        {
            **{f"incoming_{n}": total(F.col("qty"), along.rangeBetween(n, n)) for n in range(HORIZON)},
            "unscheduled": total(F.when(F.col("_at").isNull(), F.col("qty")), all_months),
            "overdue": total(dated, along.rangeBetween(Window.unboundedPreceding, -1)),
        }
    )
    return sums.filter(F.col("cycle_id").isNotNull()).drop("incoming_snapshot_id", "_at", "qty")


def forecast_cells(cycles: DataFrame, lines: DataFrame) -> DataFrame:
    """Forecast per product and channel over T..T+3, only cells that hold one."""
    start = F.col("cycle_month")
    kept = lines.select("forecast_version_id", "product_id", "channel_id", "forecast_month", "forecast_qty")
    values = cycles.select("cycle_id", "cycle_month", "forecast_version_id").join(kept, "forecast_version_id")
    return values.groupBy("cycle_id", "product_id", "channel_id").agg(
        *[F.max(F.when(F.col("forecast_month") == month_offset(start, n), F.col("forecast_qty"))).alias(f"forecast_{n}") for n in range(HORIZON)]
    )


def forecast_grid(cells: DataFrame, products: DataFrame, channels: DataFrame) -> DataFrame:
    """The planning sheet: every channel for every product of a cycle.

    What is missing stays NULL. ``products``: cycle_id, product_id;
    ``channels``: cycle_id, channel_id. Cells outside both lists are kept.
    """
    key = ["cycle_id", "product_id", "channel_id"]
    listed = products.select("cycle_id", "product_id").join(channels.select("cycle_id", "channel_id"), "cycle_id")
    return listed.select(*key).unionByName(cells.select(*key)).distinct().join(cells, key, "left")


def forecast_totals(cells: DataFrame, channels: DataFrame) -> DataFrame:
    """Month totals per product; NULL when any listed channel is blank.

    Works on the cells that exist: a total stands when as many cells are filled
    as there are channels, so the full sheet is never built for it.
    """
    listed = channels.select("cycle_id", "channel_id").distinct()
    counts = listed.groupBy("cycle_id").agg(F.count(F.lit(1)).alias("_channels"))
    marked = cells.join(listed.withColumn("_listed", F.lit(True)), ["cycle_id", "channel_id"], "left").join(counts, "cycle_id", "left")
    wanted = F.coalesce(F.max("_channels"), F.lit(0)) + F.count_if(F.col("_listed").isNull())
    return marked.groupBy("cycle_id", "product_id").agg(
        *[
            F.when(F.count(f"forecast_{n}") == wanted, F.sum(f"forecast_{n}")).cast(STORED_QTY).alias(f"forecast_{n}")
            for n in range(HORIZON)
        ]
    )


def project(plan: DataFrame) -> DataFrame:
    """Four-month projection: opening + incoming - forecast, carried forward.

    A NULL anywhere makes that month and all later ones NULL. The horizon is
    fixed, so the running sum is spelled out instead of windowed.
    """
    balance = F.col("opening_qty")
    columns = {}
    for n in range(HORIZON):
        balance = balance + F.col(f"incoming_{n}") - F.col(f"forecast_{n}")
        columns[f"projected_{n}"] = balance.cast(STORED_QTY)
    return plan.withColumns(columns)


def project_months(plan: DataFrame, keys: list[str]) -> DataFrame:
    """The same projection over plan rows in long form, one row per month.

    ``plan``: keys, month, opening_qty (same on all rows), incoming_qty, forecast_qty.
    """
    upto = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    change = F.col("incoming_qty") - F.col("forecast_qty")
    blank = F.sum(F.when(change.isNull() | F.col("opening_qty").isNull(), 1).otherwise(0)).over(upto)
    return plan.withColumn("projected_qty", F.when(blank == 0, F.col("opening_qty") + F.sum(change).over(upto)).cast(STORED_QTY))


def workbench_products(
    bindings: DataFrame,
    versions: DataFrame,
    inventory: DataFrame,
    actuals: DataFrame,
    incoming: DataFrame,
    forecasts: DataFrame,
    orders: DataFrame,
) -> DataFrame:
    """Distinct (cycle, product) from supply, forecasts, orders and bound facts.

    ``incoming``, ``forecasts`` and ``orders`` carry cycle_id and product_id;
    facts count inside the bound periods of their version only.
    """
    bound = bindings.join(versions.select("dataset_version_id", "dataset_type"), "dataset_version_id")

    def from_fact(fact: DataFrame, kind: str, month: str) -> DataFrame:
        months = fact.select("dataset_version_id", "product_id", F.col(month).alias("_m")).distinct()
        periods = bound.filter(F.col("dataset_type") == kind).select("cycle_id", "dataset_version_id", "period_start", "period_end")
        return (
            months.join(periods, "dataset_version_id")
            .filter(F.col("_m").between(F.col("period_start"), F.col("period_end")))
            .select("cycle_id", "product_id")
        )

    parts = [from_fact(inventory, "INVENTORY", "inventory_month"), from_fact(actuals, "ACTUAL", "actual_month")]
    parts += [frame.select("cycle_id", "product_id") for frame in (incoming, forecasts, orders)]
    return _union(parts).distinct()


def identities(cycles: DataFrame, wanted: DataFrame, masters: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """Display identity per (cycle, ``key``): masters while OPEN, the frozen
    snapshot once LOCKED, never current names for a locked cycle.

    ``masters`` and ``snapshots`` share their columns; ``identity_missing`` marks gaps.
    """
    columns = [c for c in masters.columns if c != key]
    status = wanted.join(cycles.select("cycle_id", "status"), "cycle_id")
    live = status.filter(F.col("status") != "LOCKED").join(masters.withColumn("_found", F.lit(True)), key, "left")
    frozen = status.filter(F.col("status") == "LOCKED").join(
        snapshots.select("cycle_id", key, *columns).withColumn("_found", F.lit(True)), ["cycle_id", key], "left"
    )
    both = live.select("cycle_id", key, *columns, "_found").unionByName(frozen.select("cycle_id", key, *columns, "_found"))
    return both.withColumn("identity_missing", F.col("_found").isNull()).drop("_found")


def workbench_rows(
    cycles: DataFrame,
    products: DataFrame,
    identity: DataFrame,
    opening: DataFrame,
    incoming: DataFrame,
    totals: DataFrame,
    orders: DataFrame,
) -> DataFrame:
    """One row per cycle and product: identity, stock, supply, forecast, order.

    Supply is NULL when the cycle has no snapshot and zero when it has one
    without lines for the product.
    """
    key = ["cycle_id", "product_id"]
    has_snapshot = F.col("incoming_snapshot_id").isNotNull()
    supply = [*[f"incoming_{n}" for n in range(HORIZON)], "unscheduled", "overdue"]
    joined = (
        products.join(cycles.select("cycle_id", "cycle_month", "incoming_snapshot_id"), "cycle_id")
        .join(identity, key, "left")
        .join(opening, key, "left")
        .join(incoming, key, "left")
        .join(totals, key, "left")
        .join(orders.select(*key, "order_qty", F.col("status").alias("_order")), key, "left")
    )
    filled = {c: F.when(has_snapshot, F.coalesce(c, F.lit(0).cast(STORED_QTY))) for c in supply}
    return project(joined.withColumns(filled)).withColumn("confirmation", F.coalesce("_order", F.lit("Missing"))).drop("_order", "incoming_snapshot_id")


def sku_reconciliation(sku_month: DataFrame, product_month: DataFrame, *scope: str) -> DataFrame:
    """SKU totals against the product total: reconciled when total and policy agree."""
    sums = sku_month.groupBy(*scope, "product_id").agg(
        F.sum("ending_qty").cast(STORED_QTY).alias("sku_total"),
        F.min("warehouse_policy_version").alias("_p1"),
        F.max("warehouse_policy_version").alias("_p2"),
    )
    fact = product_month.select(*scope, "product_id", F.col("ending_qty").alias("product_total"), "warehouse_policy_version")
    joined = sums.join(fact, [*scope, "product_id"], "full")
    agree = (
        (F.col("sku_total") == F.col("product_total"))
        & (F.col("_p1") == F.col("warehouse_policy_version"))
        & (F.col("_p2") == F.col("warehouse_policy_version"))
    )
    return joined.withColumn("reconciled", F.coalesce(agree, F.lit(False))).drop("_p1", "_p2", "warehouse_policy_version")


def sku_shares(sku_month: DataFrame, reconciliation: DataFrame, *scope: str) -> DataFrame:
    """Non-zero SKU stocks with their percentage of a reconciled product."""
    joined = sku_month.filter(F.col("ending_qty") != 0).join(reconciliation, [*scope, "product_id"])
    percent = F.bround(F.col("ending_qty") / F.when(F.col("product_total") != 0, F.col("product_total")) * 100, 2).cast("decimal(18,2)")
    return joined.select(*scope, "product_id", "sku_id", "ending_qty", F.when(F.col("reconciled"), percent).alias("proportion"))


# --- forecasts -------------------------------------------------------------


def check_forecast_lines(lines: DataFrame, cycles: DataFrame, channels: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with resolved ids and the code of the first rule they break.

    ``lines``: cycle_id, channel_stable_id, product_stable_id, forecast_month, forecast_qty.
    """
    grain = ["cycle_id", "channel_stable_id", "product_stable_id", "forecast_month"]
    cleaned = lines.withColumns(
        {
            "channel_stable_id": blank_to_null("channel_stable_id"),
            "product_stable_id": blank_to_null("product_stable_id"),
            "_valid": forecast_valid("forecast_qty"),
            "_exact": order_quantity("forecast_qty"),
        }
    )
    repeated = cleaned.groupBy(*grain).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    joined = (
        cleaned.join(cycles.select("cycle_id", "cycle_month", "status"), "cycle_id", "left")
        .join(channels.select("channel_stable_id", "channel_id"), "channel_stable_id", "left")
        .join(products.select("product_stable_id", "product_id"), "product_stable_id", "left")
        .join(repeated, grain, "left")
    )
    month = F.col("forecast_month")
    code = (
        F.when(F.col("status").isNull(), "CYCLE_NOT_FOUND")
        .when(F.col("status") != "OPEN", "CYCLE_LOCKED")
        .when(F.col("channel_stable_id").isNull() | F.col("product_stable_id").isNull(), "IDENTITY_REQUIRED")
        .when(~F.coalesce(F.dayofmonth(month) == 1, F.lit(False)), "MONTH_NOT_FIRST_DAY")
        .when(~month.between(F.col("cycle_month"), month_offset("cycle_month", HORIZON - 1)), "MONTH_OUTSIDE_HORIZON")
        .when(~F.col("_valid"), "QUANTITY_INVALID")
        .when(F.col("_exact").isNull(), "QUANTITY_NOT_EXACT")
        .when(F.col("channel_id").isNull() | F.col("product_id").isNull(), "IDENTITY_UNRESOLVED")
        .when(F.col("_copies").isNotNull(), "DUPLICATE_GRAIN")
    )
    return joined.withColumn("code", code).select(
        "cycle_id", "channel_stable_id", "product_stable_id", "channel_id", "product_id", "forecast_month", F.col("_exact").alias("forecast_qty"), "code"
    )


def next_version(versions: DataFrame, key: str, number: str = "version_no") -> DataFrame:
    """Next number per key."""
    return versions.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_no"))


def append_forecast_version(checked: DataFrame, versions: DataFrame) -> DataFrame:
    """Lines of each cycle's new version; a cycle with one bad line gets none."""
    bad = checked.filter("code is not null").select("cycle_id").distinct()
    numbers = next_version(versions, "cycle_id")
    good = checked.join(bad, "cycle_id", "left_anti").join(numbers, "cycle_id", "left")
    return good.select(
        "cycle_id", F.coalesce("next_no", F.lit(1)).alias("version_no"), "channel_id", "product_id", "forecast_month", "forecast_qty"
    )


def forecast_save_findings(requests: DataFrame, cycles: DataFrame, stored_lines: DataFrame) -> DataFrame:
    """Why a forecast save is refused.

    ``requests``: cycle_id, expected_version_id. The adopted version must be
    the expected one and hold no month outside the horizon.
    """
    joined = requests.join(cycles, "cycle_id", "left")
    outside = (
        cycles.select("cycle_id", "cycle_month", "forecast_version_id")
        .join(stored_lines.select("forecast_version_id", "forecast_month"), "forecast_version_id")
        .filter(~F.col("forecast_month").between(F.col("cycle_month"), month_offset("cycle_month", HORIZON - 1)))
        .select("cycle_id")
        .distinct()
        .withColumn("_outside", F.lit(True))
    )
    checked = joined.join(outside, "cycle_id", "left")
    rules = {
        "CYCLE_NOT_FOUND": F.col("status").isNull(),
        "CYCLE_LOCKED": F.col("status") == "LOCKED",
        "FORECAST_SELECTION_CHANGED": F.col("status").isNotNull() & ~F.col("forecast_version_id").eqNullSafe(F.col("expected_version_id")),
        "STORED_MONTH_OUTSIDE_HORIZON": F.col("_outside"),
    }
    found = F.filter(F.array(*[F.when(test, F.lit(code)) for code, test in rules.items()]), lambda c: c.isNotNull())
    return checked.select("cycle_id", F.explode(found).alias("code"))


def forecast_history(versions: DataFrame, lines: DataFrame, channel_identity: DataFrame, product_identity: DataFrame) -> DataFrame:
    """All lines of all versions with the identities valid for their cycle."""
    return (
        lines.join(versions.select("forecast_version_id", "cycle_id", "version_no"), "forecast_version_id")
        .join(channel_identity.drop("identity_missing"), ["cycle_id", "channel_id"], "left")
        .join(product_identity.drop("identity_missing"), ["cycle_id", "product_id"], "left")
    )


def latest_forecast(cycles: DataFrame, versions: DataFrame) -> DataFrame:
    """Version shown per cycle: the adopted one when locked, else the highest."""
    highest = versions.groupBy("cycle_id").agg(F.max_by("forecast_version_id", "version_no").alias("_highest"))
    joined = cycles.select("cycle_id", "status", "forecast_version_id").join(highest, "cycle_id")
    shown = F.when(F.col("status") == "LOCKED", F.col("forecast_version_id")).otherwise(F.col("_highest"))
    return joined.select("cycle_id", shown.alias("forecast_version_id"))


# --- orders ----------------------------------------------------------------


def apply_orders(orders: DataFrame, revisions: DataFrame, changes: DataFrame, actor: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Orders after the changes, and the revisions to append.

    ``changes``: cycle_id, product_id, new_qty (already exact). A new order is
    UNCONFIRMED; a changed quantity keeps the former state as a revision and
    resets the confirmation; the same quantity changes nothing.
    """
    key = ["cycle_id", "product_id"]
    old = orders.select(*key, "order_qty", "status", "confirmed_by", "confirmed_at", "updated_by", "updated_at").withColumn("_known", F.lit(True))
    joined = old.join(changes.select(*key, "new_qty"), key, "full")
    changed = F.col("_known").isNotNull() & F.col("new_qty").isNotNull() & (F.col("new_qty") != F.col("order_qty"))
    created = F.col("_known").isNull()
    touched = changed | created
    keep = ~(touched & (created | (F.col("status") == "CONFIRMED")))
    after = joined.select(
        *key,
        F.when(touched, F.col("new_qty")).otherwise(F.col("order_qty")).cast(STORED_QTY).alias("order_qty"),
        F.when(keep, F.col("status")).otherwise("UNCONFIRMED").alias("status"),
        F.when(keep, F.col("confirmed_by")).alias("confirmed_by"),
        F.when(keep, F.col("confirmed_at")).alias("confirmed_at"),
        F.when(touched, F.lit(actor)).otherwise(F.col("updated_by")).alias("updated_by"),
        F.when(touched, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    numbers = revisions.groupBy(*key).agg(F.max("revision_no").alias("_no"))
    appended = (
        joined.filter(changed)
        .join(numbers, key, "left")
        .select(
            *key,
            (F.coalesce("_no", F.lit(0)) + 1).alias("revision_no"),
            "order_qty",
            "status",
            "confirmed_by",
            "confirmed_at",
            F.lit(actor).alias("created_by"),
            now.alias("created_at"),
        )
    )
    return after, appended


def confirm_orders(orders: DataFrame, wanted: DataFrame, actor: str, now: Column) -> DataFrame:
    """Orders with the wanted ones confirmed; a confirmed one stays as it was."""
    key = ["cycle_id", "product_id"]
    joined = orders.join(wanted.select(*key).distinct().withColumn("_w", F.lit(True)), key, "left")
    confirm = F.col("_w").isNotNull() & (F.col("status") != "CONFIRMED")
    return joined.withColumns(
        {
            "confirmed_by": F.when(confirm, F.lit(actor)).otherwise(F.col("confirmed_by")),
            "confirmed_at": F.when(confirm, now).otherwise(F.col("confirmed_at")),
            "status": F.when(confirm, "CONFIRMED").otherwise(F.col("status")),
        }
    ).select(*orders.columns)


def unknown_orders(orders: DataFrame, wanted: DataFrame) -> DataFrame:
    """Confirmation requests without an order."""
    return wanted.join(orders, ["cycle_id", "product_id"], "left_anti")


def revision_chain(revisions: DataFrame, orders: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """Order history: from each stored quantity to the next one, last to the current."""
    key = ["cycle_id", "product_id"]
    chained = next_in_group(revisions, key, "revision_no", "order_qty", "_next", block_rows)
    current = orders.select(*key, F.col("order_qty").alias("_current"))
    return chained.join(current, key, "left").select(
        *key, "revision_no", F.col("order_qty").alias("from_qty"), F.coalesce("_next", "_current").alias("to_qty")
    )


# --- lock ------------------------------------------------------------------


def lock_findings(
    requests: DataFrame,
    cycles: DataFrame,
    bindings: DataFrame,
    versions: DataFrame,
    snapshots: DataFrame,
    forecasts: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    product_master: DataFrame,
    channels: DataFrame,
    channel_master: DataFrame,
    product_snapshots: DataFrame,
    channel_snapshots: DataFrame,
) -> DataFrame:
    """Everything that keeps a cycle from being locked: (cycle_id, code).

    ``requests``: cycle_id, incoming_snapshot_id, forecast_version_id.
    ``products`` and ``channels`` are the (cycle, id) pairs to be frozen.
    """
    ids = requests.select("cycle_id")

    def finding(frame: DataFrame, code: str) -> DataFrame:
        return frame.select("cycle_id").distinct().select("cycle_id", F.lit(code).alias("code"))

    checked = binding_validity(bindings.join(ids, "cycle_id", "left_semi"), versions)

    def without_type(kind: str) -> DataFrame:
        return ids.join(checked.filter(F.col("dataset_type") == kind).select("cycle_id"), "cycle_id", "left_anti")

    mine = orders.join(ids, "cycle_id", "left_semi")
    parts = [
        finding(ids.join(cycles.filter(F.col("status") == "OPEN"), "cycle_id", "left_anti"), "CYCLE_NOT_OPEN"),
        finding(checked.filter(F.col("binding_state") != "VALID"), "BINDING_INVALID"),
        finding(overlapping_months(bindings.join(ids, "cycle_id", "left_semi"), versions, same_version_allowed=True), "CONFLICTING_VERSIONS"),
        finding(without_type("ACTUAL"), "ACTUAL_BINDING_MISSING"),
        finding(without_type("INVENTORY"), "INVENTORY_BINDING_MISSING"),
        finding(requests.join(snapshots.select("incoming_snapshot_id"), "incoming_snapshot_id", "left_anti"), "INCOMING_SNAPSHOT_MISSING"),
        finding(requests.join(forecasts.select("cycle_id", "forecast_version_id"), ["cycle_id", "forecast_version_id"], "left_anti"), "FORECAST_NOT_IN_CYCLE"),
        finding(ids.join(mine.select("cycle_id"), "cycle_id", "left_anti"), "ORDER_MISSING"),
        finding(mine.filter(F.col("status") != "CONFIRMED"), "ORDER_UNCONFIRMED"),
        finding(products.join(ids, "cycle_id", "left_semi").join(product_master.select("product_id"), "product_id", "left_anti"), "PRODUCT_UNRESOLVED"),
        finding(channels.join(ids, "cycle_id", "left_semi").join(channel_master.select("channel_id"), "channel_id", "left_anti"), "CHANNEL_UNRESOLVED"),
        finding(
            product_snapshots.select("cycle_id").unionByName(channel_snapshots.select("cycle_id")).join(ids, "cycle_id", "left_semi"),
            "SNAPSHOT_ALREADY_PRESENT",
        ),
    ]
    return _union(parts)


def freeze_identities(wanted: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """Snapshot rows: (cycle, id) with today's master identity."""
    return wanted.select("cycle_id", key).distinct().join(master, key)


def lock_cycles(cycles: DataFrame, requests: DataFrame, findings: DataFrame, actor: str, now: Column) -> DataFrame:
    """Cycles after locking every request without a finding."""
    accepted = requests.join(findings.select("cycle_id").distinct(), "cycle_id", "left_anti").select(
        "cycle_id", F.col("incoming_snapshot_id").alias("_s"), F.col("forecast_version_id").alias("_f"), F.lit(True).alias("_lock")
    )
    joined = cycles.join(accepted, "cycle_id", "left")
    lock = F.col("_lock").isNotNull()
    return joined.withColumns(
        {
            "incoming_snapshot_id": F.when(lock, F.col("_s")).otherwise(F.col("incoming_snapshot_id")),
            "forecast_version_id": F.when(lock, F.col("_f")).otherwise(F.col("forecast_version_id")),
            "locked_by": F.when(lock, F.lit(actor)).otherwise(F.col("locked_by")),
            "locked_at": F.when(lock, now).otherwise(F.col("locked_at")),
            "status": F.when(lock, "LOCKED").otherwise(F.col("status")),
        }
    ).select(*cycles.columns)


def choose_sources(bindings: DataFrame, chosen: DataFrame, cycles: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bindings after replacing those of the requesting cycles, and the refusals.

    A cycle with any invalid or overlapping choice keeps its former bindings.
    """
    ids = chosen.select("cycle_id").distinct()
    refused = _union(
        [
            ids.join(cycles.filter(F.col("status") == "OPEN"), "cycle_id", "left_anti").select("cycle_id", F.lit("CYCLE_NOT_OPEN").alias("code")),
            binding_validity(chosen, versions)
            .filter(F.col("binding_state") != "VALID")
            .select("cycle_id", F.lit("BINDING_INVALID").alias("code")),
            overlapping_months(chosen, versions, same_version_allowed=False).select("cycle_id", F.lit("SOURCE_MONTHS_OVERLAP").alias("code")),
        ]
    ).distinct()
    accepted = ids.join(refused.select("cycle_id"), "cycle_id", "left_anti")
    kept = bindings.join(accepted, "cycle_id", "left_anti").unionByName(chosen.join(accepted, "cycle_id", "left_semi").select(*bindings.columns))
    return kept, refused


def missing_ids(requested: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """Requested ids the master does not have."""
    return requested.select(key).filter(F.col(key).isNotNull()).distinct().join(master.select(key), key, "left_anti")


def duplicate_grains(lines: DataFrame, *grain: str) -> DataFrame:
    return lines.groupBy(*grain).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def locked_writes(writes: DataFrame, cycles: DataFrame, bindings: DataFrame) -> DataFrame:
    """Writes to refuse: they touch a version bound by a LOCKED cycle, or the
    bindings, forecasts or orders of a cycle that is not OPEN.

    ``writes``: write_id, table_name, dataset_version_id, cycle_id.
    """
    locked = cycles.filter(F.col("status") == "LOCKED").select("cycle_id")
    versions = bindings.join(locked, "cycle_id", "left_semi").select("dataset_version_id").distinct()
    closed = cycles.filter(F.col("status") != "OPEN").select("cycle_id")
    by_version = writes.join(versions, "dataset_version_id", "left_semi").select("write_id", "table_name", F.lit("VERSION_LOCKED").alias("code"))
    by_cycle = writes.join(closed, "cycle_id", "left_semi").select("write_id", "table_name", F.lit("CYCLE_NOT_OPEN").alias("code"))
    return by_version.unionByName(by_cycle)
