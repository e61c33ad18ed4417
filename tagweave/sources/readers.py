"""Readers of interchange JSON and pages into tables, and snapshot writers. Schemas are stated, never inferred."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.fields import parse_price, strip_desc, tag_names
from tagweave.sources import json_ranges
from tagweave.sources.scratch import written

CATALOG = "product_id string, name string, url string, thumbnail_url string, shop_name string, shop_url string, price int, has_vrchat_badge boolean"
STATS = "wish int, published_at string, price int, tags array<string>, desc string, checked_at string"
ITEM = "tags array<struct<name: string>>, description string, wish_lists_count int, published_at string, price string"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """(json) of each small file, such as a dictionary overlay, one row; a missing path gives no rows."""
    try:
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "json string")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of items, read by byte ranges; of items with one id the last wins, by file and place."""
    fields = [x.split(" ")[0] for x in CATALOG.split(", ")]
    rows = json_ranges.elements(spark, path).select(F.struct("file", "at").alias("place"), F.from_json("element", CATALOG).alias("r"))
    last = rows.where("r.product_id is not null").groupBy("r.product_id").agg(F.max_by("r", "place").alias("r"))
    return last.select(*[F.col(f"r.{c}").alias(c) for c in fields])


def read_tag_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, items) of JSON objects {id: {tag: conf}}; items has those with empty vectors too."""
    maps = written(json_ranges.last_entries(spark, path, "map<string, double>"), "vectors")
    return maps.select("item_id", F.explode("v").alias("tag", "conf")), maps.select("item_id")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of JSON objects {id: {...}}; missing fields are null, a missing path has no rows."""
    return json_ranges.last_entries(spark, path, STATS).select("item_id", "v.*")


def read_image_tags(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(image tags, images) of JSON objects {id: [{tag: conf}]}."""
    lists = json_ranges.last_entries(spark, path, "array<map<string, double>>").select("item_id", F.posexplode("v").alias("image_no", "v"))
    images = written(lists, "images")
    return images.select("item_id", "image_no", F.explode("v").alias("tag", "conf")), images.select("item_id", "image_no")


def parse_item_json(df: DataFrame, col: str = "json", cap: int = 3000) -> DataFrame:
    """df with wish, published_at, price, tags and desc of an item's JSON."""
    r = F.from_json(col, ITEM)
    price = F.try_variant_get(F.try_parse_json(col), "$.price", "variant")
    none = F.schema_of_variant(price).rlike("^(BIGINT|DECIMAL|DOUBLE)") & (F.to_json(price).try_cast("double") == 0)  # the number 0 is no price, the text is
    return df.withColumns({
        "wish": F.coalesce(r["wish_lists_count"], F.lit(0)), "published_at": F.coalesce(r["published_at"], F.lit("")),
        "price": F.when(F.coalesce(none, F.lit(False)), None).otherwise(parse_price(r["price"])), "tags": F.coalesce(tag_names(r["tags"]), F.array().cast("array<string>")), "desc": strip_desc(r["description"], cap),
    })


def parse_item_meta(df: DataFrame, col: str = "json") -> DataFrame:
    """df with tags, description and error; JSON that can't be read gives no tags, no description and error = true."""
    r = F.from_json(col, ITEM + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    bad = F.col("r_").isNull() | F.col("r_._bad").isNotNull()
    out = df.withColumn("r_", r)
    return out.withColumns({
        "tags": F.when(bad, F.array().cast("array<string>")).otherwise(F.coalesce(tag_names(F.col("r_.tags")), F.array().cast("array<string>"))),
        "description": F.when(bad, "").otherwise(F.coalesce("r_.description", F.lit(""))), "error": bad,
    }).drop("r_")


def image_urls(html: Column, item_id: Column, cap: int = 6) -> Column:
    """Image URLs (data-origin) of the item in order, each once, the first cap."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit('data-origin="([^"]+)"'), F.lit(1)))
    return F.slice(F.filter(found, lambda u: u.contains(F.concat(F.lit("/i/"), item_id, F.lit("/")))), 1, cap)


def og_field(html: Column, name: str) -> Column:
    """Content of an og: property, its attributes in either order; null without one."""
    first = F.regexp_extract(html, rf'<meta property="og:{name}" content="([^"]+)"', 1)
    last = F.regexp_extract(html, rf'<meta content="([^"]+)" property="og:{name}"', 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(last, F.lit("")))


def extract_og(pages: DataFrame, base: str = "https://example.com/items/") -> DataFrame:
    """Catalog rows of item pages (item_id, html): name from og:title, else the id; thumbnail from og:image; no price, no badge."""
    none = F.lit(None).cast("string")
    return pages.select(
        "item_id", F.coalesce(og_field(F.col("html"), "title"), "item_id").alias("name"), F.concat(F.lit(base), "item_id").alias("url"),
        og_field(F.col("html"), "image").alias("thumbnail_url"), none.alias("shop_name"), none.alias("shop_url"), F.lit(None).cast("int").alias("price"), F.lit(False).alias("has_badge"),
    )


def resized_url(url: Column, host: str = "https://[^/]+", size: int = 300) -> Column:
    """The thumbnail of a size of an original image of an item (/i/<digits>/ in its path); other URLs unchanged. The match
    begins at the start and need not reach the end."""
    at = rf"^({host})/(.+/i/\d+/[^.]+)\.\w+"
    return F.when(url.rlike(at), F.concat(F.regexp_extract(url, at, 1), F.lit(f"/c/{size}x{size}_a2_g5/"), F.regexp_extract(url, at, 2), F.lit("_base_resized.jpg"))).otherwise(url)


#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Cards(HTMLParser):
    """Cards of a listing page: li.item-card with an id. Texts go to what is open around them."""

    def __init__(self) -> None:
        super().__init__()
        self.rows, self.card, self.depth, self.open = [], None, 0, []

    def _take(self, name: str, value: str | None = "") -> bool:
        new = name not in self.card
        self.card.setdefault(name, value)
        return new

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a, into = dict(attrs), []
        kinds = set((a.get("class") or "").split())
        if tag == "li" and "item-card" in kinds and a.get("data-product-id"):
            self.card, self.depth = {"attrs": a}, len(self.open)
            self.rows.append(self.card)
        elif self.card is not None:
            if tag == "a":
                for name, on in (("anchor", "item-card__title-anchor--multiline" in kinds), ("title", any("item-card__title" in k for _, k, _ in self.open[self.depth :]))):
                    if on and self._take(name):
                        self.card[name + "_url"] = a.get("href")
                        into.append(name)
                if "js-thumbnail-image" in kinds and a.get("data-original") is not None:
                    self._take("thumbnail", a["data-original"])
                if "item-card__shop-name-anchor" in kinds:
                    self._take("shop_url", a.get("href"))
            if "item-card__shop-name" in kinds and self._take("shop"):
                into.append("shop")
            if tag == "img" and "badges/vrchat" in (a.get("src") or ""):
                self.card["badge"] = True
        if tag not in VOID:
            self.open.append((tag, kinds, into))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]
            if self.card is not None and at <= self.depth:
                self.card = None

    def handle_data(self, data: str) -> None:
        if self.card is not None:
            for _, _, into in self.open[self.depth :]:
                for name in into:
                    self.card[name] += data.strip()


def _listing_row(card: dict, base: str) -> dict:
    a, at = card["attrs"], "anchor" if "anchor" in card else "title"
    price = a.get("data-product-price") or ""
    return {
        "item_id": a["data-product-id"], "name": card[at] if at in card else a.get("data-product-name") or "", "url": card.get(at + "_url") or base + a["data-product-id"],
        "thumbnail_url": card.get("thumbnail"), "shop_name": card.get("shop"), "shop_url": card.get("shop_url"),
        "price": int(price) if price.isdecimal() else None, "has_badge": card.get("badge", False),
    }


LISTING = "page long, pos int, item_id string, name string, url string, thumbnail_url string, shop_name string, shop_url string, price int, has_badge boolean"


def parse_listing_pages(pages: DataFrame, base: str = "https://example.com/items/") -> DataFrame:
    """Catalog rows of listing pages (page, html): one per card with an id: the title's text and link, else the name attribute and a
    link built from the id; the price if it is all digits. Many small partitions suit this."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, html in zip(frame["page"], frame["html"]):
                cards = _Cards()
                cards.feed(html or "")
                out += [{**_listing_row(c, base), "page": page, "pos": pos} for pos, c in enumerate(cards.rows)]
            yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in LISTING.split(", ")]).astype({"price": "Int32"})

    return pages.select(F.col("page").cast("long").alias("page"), "html").mapInPandas(parse, LISTING)


def write_snapshot(df: DataFrame, folder: str, version: str) -> str:
    """A new version directory under folder; earlier ones stay."""
    path = f"{folder}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def vectors_as_json(vectors: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, json): each item's vector as a JSON object with sorted tags."""
    maps = vectors.groupBy("item_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "conf"))))).alias("json"))
    return items.join(maps, "item_id", "left").select("item_id", F.coalesce("json", F.lit("{}")).alias("json"))
