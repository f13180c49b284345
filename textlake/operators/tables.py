"""Changes to tables, as new tables: upserts, cascades, latest marks, ledgers, incremental crawls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """New rows replace old ones of equal keys; keys in new are unique."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def cascade(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows of a child table whose parent was not deleted."""
    return child.join(deleted.select(key), key, "left_anti")


def latest(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """The last row of each key: one aggregate, no sort."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, "r.*")


def spend(positions: DataFrame, amount: Column | float, account: str = "account") -> DataFrame:
    """positions(account, item, units, price) -> with taken: units given up to pay `amount`, cheapest first.

    Whole units; the last position gives as many as the rest needs, rounded up. Nothing is taken beyond it.
    """
    amount = F.lit(amount) if not isinstance(amount, Column) else amount
    before = Window.partitionBy(account).orderBy("price", "item").rowsBetween(Window.unboundedPreceding, -1)
    paid = F.coalesce(F.sum(F.col("units") * F.col("price")).over(before), F.lit(0))
    need = F.greatest(amount - paid, F.lit(0))
    return positions.withColumn("taken", F.least("units", F.ceil(F.try_divide(need, "price"))).cast("long"))


def personal_price(df: Column, documents: Column, hits: Column) -> Column:
    """Price of a lemma: at least 1, 100 per decade of rarity, falling 3 % a hit down to a fifth; half-even rounding."""
    base = F.greatest(F.lit(1), F.bround(100 * F.log10(documents / df)))
    return F.greatest(F.lit(1), F.bround(base * F.greatest(F.lit(0.2), F.pow(F.lit(0.97), hits)))).cast("long")


def crawl_changes(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """Both (path, mtime, size_bytes, content_hash) -> (path, change): added, updated, skipped or removed.

    Equal time (within a microsecond) and size skip; so does an equal hash, whatever the time.
    """
    both = stored.alias("s").join(listing.alias("l"), "path", "full")
    same = (F.abs(F.col("s.mtime") - F.col("l.mtime")) <= 1e-6) & (F.col("s.size_bytes") == F.col("l.size_bytes"))
    change = F.when(F.col("s.mtime").isNull(), "added").when(F.col("l.mtime").isNull(), "removed").when(same | (F.col("s.content_hash") == F.col("l.content_hash")), "skipped").otherwise("updated")
    return both.select("path", change.alias("change"))


def streaks(events: DataFrame, user: str = "user_id", ts: str = "ts", gap_minutes: int = 10, order: str = "event_id") -> DataFrame:
    """(user, streak, started, ended, n): runs of events each less than the gap after the one before."""
    w = Window.partitionBy(user).orderBy(ts, order)
    apart = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(w))
    new = F.when(apart.isNull() | (apart >= gap_minutes * 60_000_000), 1).otherwise(0)
    numbered = events.withColumn("_new", new).withColumn("streak", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(user, "streak").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def wave_sizes(groups: DataFrame, waves: int) -> DataFrame:
    """groups(id, total) -> (id, wave, size): shares 1 : 2 : ... : waves, remainders to the largest fractions, later first."""
    parts = waves * (waves + 1) / 2
    rows = groups.select("id", "total", F.explode(F.sequence(F.lit(1), F.lit(waves))).alias("wave")).withColumn("exact", F.col("total") * F.col("wave") / parts)
    w = Window.partitionBy("id")
    cut = rows.withColumn("base", F.floor("exact")).withColumns({"left": F.col("total") - F.sum("base").over(w), "n": F.row_number().over(w.orderBy(F.desc(F.col("exact") - F.col("base")), F.desc("wave")))})
    return cut.select("id", "wave", (F.col("base") + F.when(F.col("n") <= F.col("left"), 1).otherwise(0)).alias("size"))


def under_roots(roots: DataFrame, paths: DataFrame) -> DataFrame:
    """roots(root_path, ...) and paths(path) -> roots with documents: how many paths lie under each. A path brings every
    folder above it, so the sides meet by equality."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    counts = paths.select(F.explode(above).alias("root_path")).groupBy("root_path").agg(F.count("*").alias("documents"))
    return roots.join(counts, "root_path", "left").na.fill(0, ["documents"])
