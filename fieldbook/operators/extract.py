"""Pages to records: fields, sections, galleries, tables, with warnings as rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldbook.functions.text import Entities, clean_text, collapse_ws, strip_tags


def field(html: Column, pattern: str, only: Entities | None = None) -> Column:
    """The text of a scalar field, '' where it is absent."""
    return collapse_ws(strip_tags(F.regexp_extract(html, pattern, 1)), only)


def section_map(rows: DataFrame, headings: dict[str, str], skip: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(id, sections map) and warnings (id, warning); rows has id, heading, body.

    Headings are compared without case; skipped ones go, unknown ones are reported.  The first of
    several sections of one key counts.
    """
    h = F.lower(F.trim("heading"))
    known = F.create_map(*[F.lit(x) for kv in headings.items() for x in kv])
    keyed = rows.select("id", "heading", "body", "pos", F.try_element_at(known, h).alias("key"), h.isin(*skip).alias("skipped") if skip else F.lit(False).alias("skipped")).where("NOT skipped")
    first = keyed.where("key IS NOT NULL AND body <> ''").groupBy("id", "key").agg(F.min_by("body", "pos").alias("body"))
    sections = first.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "body")))).alias("sections"))
    return sections, keyed.where("key IS NULL").select("id", F.concat(F.lit("unknown heading: "), "heading").alias("warning"))


def sibling_sections(blocks: DataFrame) -> DataFrame:
    """(id, heading, body): blocks (id, pos, tag, text) after each h2 up to the next h1 or h2; links to the top go."""
    order = W.partitionBy("id").orderBy("pos")
    b = blocks.withColumn("n", F.count_if(F.col("tag").isin("h1", "h2")).over(order))
    heads = b.where("tag = 'h2'").select("id", "n", F.col("text").alias("heading"))
    parts = b.where("tag NOT IN ('h1', 'h2') AND lower(trim(text)) NOT IN ('top', 'back to top', '')").groupBy("id", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    return heads.join(parts, ["id", "n"], "left").select("id", "heading", F.coalesce("body", F.lit("")).alias("body"))


def skip_big_tables(blocks: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Blocks (html) without those that hold a table of over so many rows, and warnings with their counts."""
    n = F.size(F.regexp_extract_all("html", F.lit(r"(?i)<tr\b"), F.lit(0)))
    big = F.col("html").rlike(r"(?i)<table\b") & (n > most)
    return blocks.where(~big), blocks.where(big).select("id", F.concat(F.lit("table of "), n.cast("string"), F.lit(" rows skipped")).alias("warning"))


def extract_gallery(refs: DataFrame) -> DataFrame:
    """(id, pos, file, hero) from (id, pos, file, is_hero): the first place of a file counts; without a hero the first is it."""
    one = refs.groupBy("id", "file").agg(F.min("pos").alias("pos"), F.max("is_hero").alias("h"))
    w = W.partitionBy("id")
    first = F.row_number().over(w.orderBy(F.col("h").desc(), "pos")) == 1
    return one.select("id", "pos", "file", first.alias("hero"))


def extract_presence_table(pages: DataFrame, regions: DataFrame, codes: str = "CFURI") -> tuple[DataFrame, DataFrame]:
    """Cells (id, region, month, code) of every region, and warnings, from pages (id, html).

    A row belongs to the region that its own link names and counts only with twelve cells, the first of a
    region's rows if there are more; other codes are blank.  regions is the dimension (region, pos).
    """
    has = F.col("html").rlike(r"(?i)<table\b")
    row = pages.where(has).select("id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "r"))
    row = row.select("id", "pos", F.regexp_extract("r", r"(?i)href=[\"'][^\"']*/ecoregion/([a-z_-]+)", 1).alias("region"), F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(strip_tags(c))).alias("cells")).where("region <> ''")
    good = row.where("size(cells) = 12").groupBy("id", "region").agg(F.min_by("cells", "pos").alias("cells"))
    grid = pages.select("id").crossJoin(F.broadcast(regions.select("region")))
    wide = grid.join(good, ["id", "region"], "left")
    long = wide.select("id", "region", F.posexplode(F.coalesce("cells", F.array_repeat(F.lit(""), 12))).alias("m", "c"))
    cells = long.select("id", "region", (F.col("m") + 1).alias("month"), F.when(F.col("c").rlike(f"^[{codes}]$"), F.col("c")).otherwise("").alias("code"))
    short = row.where("size(cells) <> 12").select("id", F.concat(F.lit("row of "), F.size("cells").cast("string"), F.lit(" cells: "), "region").alias("warning"))
    odd = row.where("size(cells) = 12").select("id", F.explode("cells").alias("c")).where(~F.col("c").rlike(f"^[{codes}]?$")).select("id", F.concat(F.lit("unknown code: "), "c").alias("warning"))
    none = pages.where(~has).select("id", F.lit("no table: rarity").alias("warning"))
    part = wide.join(good.select("id").distinct(), "id", "left_semi").where("cells IS NULL").select("id", F.concat(F.lit("region missing: "), "region").alias("warning"))
    return cells, short.unionByName(odd).unionByName(none).unionByName(part)


def image_map_polygons(pages: DataFrame, names: dict[int, str]) -> DataFrame:
    """(region, ring) of the areas titled 'N name' with three points or more; unknown numbers go."""
    area = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<area\b[^>]*>"), F.lit(0))).alias("a"))
    number = F.regexp_extract("a", r"""(?i)title=["'](\d+)""", 1).try_cast("int")
    xy = F.transform(F.regexp_extract_all(F.regexp_extract("a", r"""(?i)coords=["']([^"']*)""", 1), F.lit(r"(-?[0-9.]+)"), F.lit(1)), lambda v: v.cast("double"))
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    p = area.select(F.try_element_at(known, number).alias("region"), xy.alias("xy")).where("region IS NOT NULL AND size(xy) >= 6")
    return p.select("region", F.transform(F.sequence(F.lit(0), (F.size("xy") / 2).cast("int") - 1), lambda i: F.struct(F.get("xy", 2 * i).alias("lon"), F.get("xy", 2 * i + 1).alias("lat"))).alias("ring"))


class _Blocks(HTMLParser):
    """Document-order texts of h2, h3, p, ul, ol and li that stand in no other block."""

    TAGS = {"h2", "h3", "p", "ul", "ol"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.tag, self.depth, self.skip, self.text = "", 0, 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in self.TAGS:
            if self.tag and (tag != "p" or self.tag == "p"):
                if self.tag == tag == "p":
                    self.finish()  # an open paragraph ends where the next begins
                else:
                    self.depth += 1
                    return
            if not self.tag:
                self.tag, self.depth, self.text = tag, 0, []
        elif tag == "li" and self.tag in ("ul", "ol"):
            self.text.append("\n- ")
        elif tag == "br" and self.tag:
            self.text.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif self.tag and tag in self.TAGS:
            if self.depth:
                self.depth -= 1
            elif tag == self.tag:
                self.finish()

    def handle_data(self, data: str) -> None:
        if self.tag and not self.skip:
            self.text.append(data)

    def finish(self) -> None:
        if self.tag:
            lines = (" ".join(x.split()) for x in "".join(self.text).split("\n"))
            text = "\n".join(x for x in lines if x)
            if text and text.lower() not in ("top", "back to top"):
                self.out.append({"h2": "## ", "h3": "### "}.get(self.tag, "") + text)
        self.tag, self.depth, self.text = "", 0, []


def page_blocks_markdown(pages: DataFrame) -> DataFrame:
    """(id, markdown): blocks in order, headings marked, equal ones once.  Tree order needs a parser, one page at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for html in f["html"]:
                parser = _Blocks()
                parser.feed(html or "")
                parser.close()
                parser.finish()
                out.append("\n\n".join(dict.fromkeys(parser.out)))
            yield pd.DataFrame({"id": f["id"], "markdown": out})

    return pages.select("id", "html").mapInPandas(run, "id long, markdown string")


def warning_digest(warnings: DataFrame, n: int = 25) -> DataFrame:
    """(id, n) of the records with most warnings."""
    return warnings.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "id").limit(n)


def body_text(html: Column) -> Column:
    return clean_text(F.regexp_extract(html, r"(?is)<article>(.*?)</article>", 1))
