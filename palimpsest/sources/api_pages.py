"""Revisions from saved API responses (``action=query``, ``prop=revisions``)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import bind
from palimpsest.materialize import cut_lineage
from palimpsest.operators.changes import ANONYMOUS

# The response's field names. The page id is a changing object key, hence a map.
API_SCHEMA = """query STRUCT<pages: MAP<STRING, STRUCT<title: STRING, revisions: ARRAY<STRUCT<revid: BIGINT,
    timestamp: STRING, user: STRING, slots: STRUCT<main: STRUCT<`*`: STRING>>>>>>>,
    requested STRING, _corrupt_record STRING"""
# The same with pages and revisions as texts, so that one of a wrong form spoils no other.
LOOSE = "query STRUCT<pages: MAP<STRING, STRING>>, requested STRING, _corrupt_record STRING"
PAGE = "title STRING, revisions STRING, _corrupt_record STRING"
REVISION = "revid STRING, timestamp STRING, user STRING, slots STRING, _corrupt_record STRING"
SLOTS = "main STRING, _corrupt_record STRING"
CONTENT = "`*` STRING, _corrupt_record STRING"
MISSING_PAGE = "-1"
ENTRIES = """ARRAY<STRUCT<article: STRING, rev_id: BIGINT, time: STRING, user: STRING, wikitext: STRING,
    entry: STRING, bad: BOOLEAN>>"""


def source_place() -> Column:
    """Where a record stands among all files read: file, split of the file, and order in the split.

    Files count in order of their names.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
    )


def read_api_pages(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Responses as saved, one per file, or one per line with ``multi_line=False``.

    Files with one response per line can be split among tasks, so they are the better form for bulk.
    All pages of a history, over any number of files, are read as one table.
    """
    reader = spark.read.schema(API_SCHEMA).option("multiLine", multi_line)
    return reader.option("mode", "PERMISSIVE").json(path).withColumn("place", source_place())


def corrupt_pages(pages: DataFrame) -> DataFrame:
    """Responses that aren't JSON, for inspection. Spark wants a parsed column with them."""
    unread = F.from_json("_corrupt_record", LOOSE)["_corrupt_record"].isNotNull()
    broken = pages.filter(F.col("_corrupt_record").isNotNull() & unread)
    return broken.select(F.col("place.file").alias("file"), "_corrupt_record", "query")


def _entry(article: Column, rev_id: Column, rev: Column, text: Column, entry: Column, bad: Column) -> Column:
    return F.struct(
        article.alias("article"),
        rev_id.alias("rev_id"),
        rev["timestamp"].alias("time"),
        rev["user"].alias("user"),
        text.alias("wikitext"),
        F.when(bad, entry).alias("entry"),
        bad.alias("bad"),
    )


def _existing(pages: Column) -> Column:
    return F.filter(F.map_entries(pages), lambda page: page["key"] != MISSING_PAGE)


def _listed(entries: Column) -> Column:
    return F.coalesce(entries.cast(ENTRIES), F.array().cast(ENTRIES))


def _typed_entries(pages: Column, requested: Column) -> Column:
    def of_page(page: Column) -> Column:
        article = F.coalesce(page["value"]["title"], requested)

        def of_revision(rev: Column) -> Column:
            bad = rev["revid"].isNull() | article.isNull()
            text = rev["slots"]["main"]["*"]
            return _entry(article, rev["revid"], rev, text, F.to_json(rev), bad)

        return _listed(F.transform(page["value"]["revisions"], of_revision))

    return _listed(F.flatten(F.transform(_existing(pages), of_page)))


def _loose_entries(text: Column) -> Column:
    """Entry by entry, for a response in which anything is of a wrong form."""

    def of_revision(article: Column, entry: Column) -> Column:
        def parsed(rev: Column) -> Column:
            slots = F.from_json(rev["slots"], SLOTS)
            content = F.from_json(slots["main"], CONTENT)
            rev_id = rev["revid"].try_cast("bigint")
            bad = entry.isNull() | rev_id.isNull() | article.isNull()
            for part in (rev, slots, content):
                bad |= part["_corrupt_record"].isNotNull()
            return _entry(article, rev_id, rev, content["*"], entry, bad)

        return bind(F.from_json(entry, REVISION), parsed)

    def of_page(entry: Column, requested: Column) -> Column:
        def parsed(page: Column) -> Column:
            article = F.coalesce(page["title"], requested)

            def of_list(revisions: Column) -> Column:
                unread = page["_corrupt_record"].isNotNull()
                unread |= page["revisions"].isNotNull() & revisions.isNull()
                nothing = F.from_json(F.lit(None).cast("string"), REVISION)
                null = F.lit(None).cast("string")
                whole = _entry(article, null.cast("bigint"), nothing, null, entry, F.lit(True))
                each = F.transform(revisions, lambda rev: of_revision(article, rev))
                return F.when(unread, F.array(whole).cast(ENTRIES)).otherwise(_listed(each))

            return bind(F.from_json(page["revisions"], "ARRAY<STRING>"), of_list)

        return bind(F.from_json(entry, PAGE), parsed)

    def of_response(response: Column) -> Column:
        pages = _existing(response["query"]["pages"])
        each = F.transform(pages, lambda page: of_page(page["value"], response["requested"]))
        return _listed(F.flatten(each))

    return bind(F.from_json(text, LOOSE), of_response)


@dataclass
class Scan:
    """Saved pages taken apart.

    ``revisions`` has one row per ``(article, rev_id)``: pages may overlap, and of copies the one that is
    last in source order counts. ``conflicts`` holds the other copies that differ from it, ``corrupt``
    the entries of a wrong form: those without readable id, without article, or with a field of a wrong
    type.
    """

    revisions: DataFrame
    conflicts: DataFrame
    corrupt: DataFrame


def scan_pages(pages: DataFrame) -> Scan:
    """All of ``pages`` parsed once and written; copies are found among their keys, without texts."""
    # Which branch is taken is decided row by row, and only that one is evaluated.
    entries = F.when(
        F.col("_corrupt_record").isNull(),
        _typed_entries(F.col("query.pages"), F.col("requested")),
    ).otherwise(_loose_entries(F.col("_corrupt_record")))
    # The outer form adds no filter that would parse everything a second time.
    found = pages.select("place", F.posexplode_outer(entries).alias("at", "entry"))
    source = F.struct("place.*", "at").alias("rev_seq")
    parsed = cut_lineage(found.select("entry.*", source).filter("bad IS NOT NULL"), "entries")
    corrupt = parsed.filter("bad").select(F.col("rev_seq.file").alias("file"), "article", "entry")
    good = parsed.filter("NOT bad").select(
        "article",
        "rev_id",
        F.try_to_timestamp("time").alias("ts"),
        F.coalesce("user", F.lit(ANONYMOUS)).alias("user"),
        "wikitext",
        "rev_seq",
    )
    key = ["article", "rev_id"]
    copies = good.groupBy(*key).agg(F.max("rev_seq").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    # As a written table its size is known, and Spark broadcasts it where that is small.
    repeated = cut_lineage(copies.filter("_n > 1").drop("_n"), "repeated")
    marked = good.join(repeated, key, "left")
    revisions = marked.filter(F.col("_kept").isNull() | (F.col("rev_seq") == F.col("_kept")))
    several = good.join(repeated, key)
    mark = F.sha2(F.to_json(F.struct("ts", "user", "wikitext")), 256)
    several = several.withColumn("_mark", mark)
    kept = several.filter(F.col("rev_seq") == F.col("_kept")).select(*key, F.col("_mark").alias("_best"))
    conflicts = several.join(kept, key).filter(F.col("_mark") != F.col("_best"))
    return Scan(revisions.drop("_kept"), conflicts.select(*good.columns), corrupt)


def corrupt_revisions(pages: DataFrame) -> DataFrame:
    """``(file, article, entry)``: revisions, or whole pages, of a wrong form in responses that are JSON."""
    return scan_pages(pages).corrupt


def revisions_from_pages(pages: DataFrame) -> DataFrame:
    """``(article, rev_id, ts, user, wikitext, rev_seq)`` of all pages that exist, as ``Scan`` says.

    A page without title goes by the ``requested`` one, if the saved response notes it. ``rev_seq`` is
    the source order, which revisions of equal time keep.
    """
    return scan_pages(pages).revisions


def write_api_pages(revisions: DataFrame, path: str) -> None:
    """Save revisions in the response form, one response per line and revision."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX")
    content = F.struct(F.struct(F.col("wikitext").alias("*")).alias("main"))
    revision = F.struct(
        F.col("rev_id").alias("revid"),
        stamp.alias("timestamp"),
        "user",
        content.alias("slots"),
    )
    page = F.struct(F.col("article").alias("title"), F.array(revision).alias("revisions"))
    pages = F.create_map(F.xxhash64("article").cast("string"), page)
    response = F.to_json(F.struct(F.struct(pages.alias("pages")).alias("query")))
    revisions.select(response.alias("value")).write.text(path)
