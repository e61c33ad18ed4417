"""Keeping the catalog fresh: de-duplicating listings, finding new items, upserts, pruning, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.operators.vectors import to_vector
from tagweave.sources import versions
from tagweave.sources.scratch import written

MAX_PAGES = 40
REFRESH = 150


def first_seen(rows: DataFrame, key: str = "item_id") -> DataFrame:
    """The first row of each key in (page, pos) order: a minimum by key, no sort of a page's rows in one place."""
    others = [c for c in rows.columns if c != key]
    least = rows.groupBy(key).agg(F.min(F.struct("page", "pos", *[c for c in others if c not in ("page", "pos")])).alias("m"))
    return least.select(key, *[F.col(f"m.{c}").alias(c) for c in others])


def dedupe_listing(rows: DataFrame, cap: int) -> DataFrame:
    return first_seen(rows).orderBy("page", "pos").limit(cap)


def expand_to(existing: DataFrame, rows: DataFrame, target: int | None = None, max_pages: int = MAX_PAGES, more: int | None = None) -> DataFrame:
    """Rows of the pages taken until the existing items and the unique new ones reach target (or `more` than the existing
    ones); whole pages, none from the first empty one on. The running sum is over one row per page, of max_pages at most."""
    rows = rows.where(F.col("page") <= max_pages)
    new = first_seen(rows).join(existing.select("item_id"), "item_id", "left_anti")
    have = existing.select("item_id").distinct().agg(F.count("*").alias("have"))
    per = rows.groupBy("page").agg(F.count("*").alias("listed")).join(new.groupBy("page").agg(F.count("*").alias("new")), "page", "left").crossJoin(have)
    before = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("reached", F.col("have") + F.coalesce(F.sum(F.coalesce("new", F.lit(0))).over(before), F.lit(0))).withColumn("gap", F.col("page") - F.row_number().over(Window.orderBy("page")))
    wanted = F.col("have") + more if target is None else F.lit(target)
    taken = per.where((F.col("reached") < wanted) & (F.col("gap") == 0)).select("page")
    return new.join(F.broadcast(taken), "page", "left_semi")


def new_items(rows: DataFrame, catalog: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """New items of the pages before the first that is empty or brings nothing new; an item of an earlier page is known.
    Of an item twice on a page the last position wins."""
    rows = rows.where(F.col("page") <= max_pages)
    others = [c for c in rows.columns if c not in ("item_id", "page", "pos")]
    own = rows.groupBy("item_id", "page").agg(F.max(F.struct("pos", *others)).alias("m"))
    least = own.groupBy("item_id").agg(F.min(F.struct("page", "m")).alias("f")).select("item_id", F.col("f.page").alias("page"), F.col("f.m.pos").alias("pos"), *[F.col(f"f.m.{c}").alias(c) for c in others])
    new = least.join(catalog.select("item_id"), "item_id", "left_anti")
    per = new.groupBy("page").agg(F.count("*").alias("n"))
    run = per.withColumn("gap", F.col("page") - F.row_number().over(Window.orderBy("page"))).where("gap = 0").select("page")
    return new.join(F.broadcast(run), "page", "left_semi")


def refresh_batch(catalog: DataFrame, stats: DataFrame, n: int = REFRESH) -> DataFrame:
    """The n items checked longest ago, never-checked ones first, ties by item_id."""
    return catalog.join(stats.select("item_id", "checked_at"), "item_id", "left").select("item_id", F.coalesce("checked_at", F.lit("")).alias("checked_at")).orderBy("checked_at", "item_id").limit(n)


def upsert(old: DataFrame, new: DataFrame, key: str = "item_id") -> DataFrame:
    """new rows replace old ones of their key; others stay. Statistics upsert; with the sides swapped, a merge in which
    existing rows win."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def merge_catalog(existing: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(rows, existing)


def augment(catalog: DataFrame, extra: DataFrame) -> DataFrame:
    return merge_catalog(catalog, extra)


def fill_stats(stats: DataFrame, fetched: DataFrame) -> DataFrame:
    """stats with tags and description filled from fetched (item_id, ok, wish, published_at, price, tags, desc).

    A known row keeps wish, date and price; after a failed fetch it gets empty tags where it had none, and an empty
    description. A new row takes what was fetched, or defaults.
    """
    s, f = stats.alias("s"), fetched.alias("f")
    known, got = F.col("s.item_id").isNotNull(), F.col("f.item_id").isNotNull()
    none = F.array().cast("array<string>")
    ok = F.coalesce(F.col("f.ok"), F.lit(False))
    pick = lambda c, default: F.when(known, F.col(f"s.{c}")).when(ok, F.col(f"f.{c}")).otherwise(default).alias(c)
    return s.join(f, F.col("s.item_id") == F.col("f.item_id"), "full_outer").select(
        F.coalesce("s.item_id", "f.item_id").alias("item_id"),
        pick("wish", F.lit(0)), pick("published_at", F.lit("")), pick("price", F.lit(None)),
        F.when(~got, F.col("s.tags")).when(ok, F.col("f.tags")).otherwise(F.coalesce("s.tags", none)).alias("tags"),
        F.when(~got, F.col("s.desc")).when(ok, F.col("f.desc")).otherwise(F.lit("")).alias("desc"),
    )


def prune(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("item_id"), "item_id", "left_anti")


def worklist(catalog: DataFrame, done: DataFrame, complete: Column | None = None, thumbnail: bool = False) -> DataFrame:
    """Items not processed yet: not in done, or there but not complete; with thumbnail, only those that have one."""
    ready = done if complete is None else done.where(complete)
    left = catalog.join(ready.select("item_id"), "item_id", "left_anti")
    return left.where("thumbnail_url is not null and thumbnail_url <> ''") if thumbnail else left


def coverage(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])


def update_report(new: DataFrame, tagged: DataFrame, refreshed: DataFrame, gone: DataFrame, catalog: DataFrame) -> DataFrame:
    """(status, n): how many items each step of an update touched."""
    parts = (("new", new), ("tagged", tagged), ("refreshed", refreshed), ("pruned", gone), ("total", catalog))
    out = None
    for name, df in parts:
        one = df.select("item_id").distinct().agg(F.lit(name).alias("status"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


def changes(new: DataFrame, refreshed: DataFrame, gone: DataFrame) -> DataFrame:
    """One row `changed`: whether any of the three has a row; at most one of each is read."""
    one = lambda df: df.select(F.lit(1).alias("x")).limit(1)
    return one(new).unionAll(one(refreshed)).unionAll(one(gone)).agg((F.count("*") > 0).alias("changed"))


def has_changes(new: DataFrame, refreshed: DataFrame, gone: DataFrame) -> bool:
    return changes(new, refreshed, gone).first()["changed"]


def run_update(catalog: DataFrame, hair: DataFrame, full: DataFrame, stats: DataFrame, listing: DataFrame, scores: DataFrame, fetched: DataFrame, vocab: DataFrame, batch: int = REFRESH, max_pages: int = MAX_PAGES) -> dict[str, DataFrame]:
    """The weekly update: catalog, hair, full and stats as they are after it, and its report.

    New items of the listing (up to the first page with nothing new) come in with vectors cut from their scores and fetched
    statistics. The `batch` items of the old catalog that were checked longest ago take fetched statistics, or go from all
    tables if they are gone. Catalog rows keep all their columns; those of new items come from the listing, null where it has
    none of that name. new_catalog, new_hair, new_full, new_stats and gone are what changed, for write_update(); `changed`
    says whether there is anything to write. fetched: item_id, status (200: found, 404: gone, others: failed) and the columns of stats.
    """
    new = new_items(listing, catalog, max_pages)
    found, gone = fetched.where("status = 200"), fetched.where("status = 404").select("item_id")
    stale = refresh_batch(catalog, stats, batch).select("item_id")
    pruned = stale.join(gone, "item_id", "left_semi")
    rows = new.select("item_id", *[c for c in new.columns if c in catalog.columns and c != "item_id"])
    tagged, refreshed = new.join(found, "item_id", "left_semi"), stale.join(found, "item_id", "left_semi")
    own = scores.join(new.select("item_id"), "item_id", "left_semi")
    fresh = found.join(new.select("item_id").unionAll(stale), "item_id", "left_semi").select(*stats.columns)
    out = {
        "catalog": prune(catalog.unionByName(rows.join(catalog.select("item_id"), "item_id", "left_anti"), allowMissingColumns=True), pruned),
        "hair": prune(hair.unionByName(to_vector(own, vocab)), pruned), "full": prune(full.unionByName(to_vector(own)), pruned),
        "stats": prune(upsert(stats, fresh), pruned),
    }
    steps = {
        "catalog": catalog.where("false").unionByName(rows.join(catalog.select("item_id"), "item_id", "left_anti"), allowMissingColumns=True), "hair": to_vector(own, vocab), "full": to_vector(own), "stats": fresh,
    }
    return out | {f"new_{name}": prune(df, pruned) for name, df in steps.items()} | {"gone": pruned, "report": update_report(new, tagged, refreshed, pruned, out["catalog"]), "changed": changes(new, refreshed, pruned)}


def write_update(done: dict[str, DataFrame], folders: dict[str, str]) -> dict[str, int]:
    """What run_update() changed, into the versioned tables (catalog, hair, full, stats) under their folders; their versions.

    Nothing is written if nothing is new, refreshed or gone. Buckets without a changed id stay as they are.
    """
    spark = done["gone"].sparkSession
    if not done["changed"].first()["changed"]:
        return {name: versions.latest(spark, folder) for name, folder in folders.items()}
    gone = written(done["gone"].select("item_id"), "gone")
    return {name: versions.update(folder, done[f"new_{name}"], gone) for name, folder in folders.items()}


#: Path prefixes left out where a site states none.
DEFAULT_DISALLOW = ("/terms", "/carts", "/cart")


def robots_rules(lines: DataFrame) -> DataFrame:
    """(site, prefix) of the groups for all agents; lines: (site, line_no, line) of the sites' short texts."""
    clean = lines.select("site", "line_no", F.btrim(F.regexp_replace("line", "#.*$", "")).alias("l")).where("instr(l, ':') > 0")
    parts = clean.select("site", "line_no", F.lower(F.btrim(F.substring_index("l", ":", 1))).alias("k"), F.btrim(F.expr("substring(l, instr(l, ':') + 1)")).alias("v")).where(F.col("k").isin("user-agent", "disallow"))
    agent = F.last(F.when(F.col("k") == "user-agent", F.col("v")), ignorenulls=True).over(Window.partitionBy("site").orderBy("line_no"))
    return parts.withColumn("agent", agent).where("k = 'disallow' and agent = '*' and v <> ''").select("site", F.col("v").alias("prefix")).distinct()


def robots_filter(urls: DataFrame, rules: DataFrame, default: tuple = DEFAULT_DISALLOW) -> DataFrame:
    """urls (site, url) whose path starts with no prefix of their site; sites without a rule have the default ones.

    A path is looked up by its own beginnings, of the lengths that its site's prefixes have: an equality join, whose rows
    grow with the number of different lengths, not with the number of rules.
    """
    rules = written(rules.select("site", "prefix").where("prefix <> ''").distinct(), "rules")
    lengths = written(rules.groupBy("site").agg(F.collect_set(F.length("prefix")).alias("lengths_")), "lengths")
    path = F.coalesce(F.expr("try_parse_url(url, 'PATH')"), F.lit(""))
    own = urls.withColumn("path_", path).join(lengths, "site", "left")
    usual = F.lit(False)
    for prefix in default:
        usual = usual | F.col("path_").startswith(prefix)
    own = own.where(F.col("lengths_").isNotNull() | ~usual)
    begins = F.explode(F.transform(F.filter("lengths_", lambda n: n <= F.length("path_")), lambda n: F.substring(F.col("path_"), F.lit(1), n))).alias("prefix")
    out = own.select("site", "path_", "lengths_").distinct().select("site", "path_", begins).join(rules, ["site", "prefix"], "left_semi").select("site", "path_").distinct()
    return own.join(out, ["site", "path_"], "left_anti").select(*urls.columns)
