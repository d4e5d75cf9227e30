"""The registered queries. Times leave as epoch seconds and texts as digests, to compare exactly."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.similarity import cosine, title_similarity
from palimpsest.functions.text import TOP
from palimpsest.materialize import cut_lineage, drop_tables, scratch_path
from palimpsest.operators.changes import changed_sections, continue_edits, section_edits
from palimpsest.operators.embed import (
    column_embedding,
    stored_embedding,
    word_vector_embedding,
)
from palimpsest.operators.labels import label_names, parse_answers, taxonomy_names
from palimpsest.operators.link import link_edits
from palimpsest.operators.ordering import number_rows
from palimpsest.operators.prompts import build_prompts, labels_text, taxonomy_lines
from palimpsest.operators.report import (
    edits_per_section,
    failed_answers,
    link_figures,
    linking_stats,
    match_distance_stats,
    match_type_stats,
    observed_answers,
    observed_links,
    parse_rate,
    revision_counts,
    sections_per_article,
)
from palimpsest.operators.sections import split_sections
from palimpsest.plans.chain import (
    label_edits,
    link_revision_types,
    link_revisions,
    prompts_for_model,
    resumed_score,
    score,
)
from palimpsest.sources.api_pages import (
    read_api_pages,
    revisions_from_pages,
    scan_pages,
    write_api_pages,
)
from palimpsest.sources.batch import (
    join_responses,
    read_errors,
    read_ledger,
    read_requests,
    read_responses,
    write_requests,
)
from palimpsest.sources.output import CSV_OPTIONS, labelled_edits, read_csv, write_csv, write_parquet
from palimpsest.sources.state import read_state, write_state
from palimpsest.sources.taxonomy import bundled_taxonomy, read_taxonomy
from workload import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LOOKBACK = 25
FILES = 4
JOINED_LIMIT = 64 * 1024
SLICES = 32
NEVER = 2.0


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def digest(column: str) -> Column:
    return F.md5(F.coalesce(column, F.lit("")))


def seconds(column: str = "ts") -> Column:
    return F.unix_seconds(column)


def joined(labels: str = "labels") -> Column:
    return F.array_join(F.transform(labels, lambda n: n.cast("string")), ",")


def explained(column: str = "explanations") -> Column:
    entries = F.array_sort(F.map_entries(column))
    lines = F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return F.array_join(lines, "\n")


# Sections and changes


@query
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sections(views.revisions(spark, sf_dir)).select(
        "article",
        "rev_id",
        "pos",
        "section",
        F.length("content").alias("n_chars"),
        digest("content").alias("content_md5"),
    )


@query
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = split_sections(views.revisions(spark, sf_dir))
    return sections.groupBy("section", "level", "level_stars").agg(
        F.count(F.lit(1)).alias("n_sections")
    )


@query
def revision_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revision_counts(views.revisions(spark, sf_dir))


@query
def section_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_columns(section_edits(views.revisions(spark, sf_dir)))


def edit_columns(edits: DataFrame) -> DataFrame:
    return edits.select(
        "article",
        "seq",
        "rev_id",
        seconds().alias("ts_seconds"),
        "user",
        "pos",
        "section",
        "level_stars",
        digest("content").alias("content_md5"),
    )


@query
def section_changes_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few articles with long histories, each of which lies in many slices."""
    return edit_columns(section_edits(views.source_revisions(spark, sf_dir), slices=SLICES))


def written_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For stages that read the revisions more than once: written they take less than made again."""
    return cut_lineage(views.revisions(spark, sf_dir), "revisions", codec="zstd")


@query
def carried_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history that comes in three parts, of which each is read without the earlier ones."""
    path = scratch_path(spark, "state")
    revisions = written_revisions(spark, sf_dir)
    turn = F.col("rev_id") % 8
    found = None
    # The second part repeats some of the first.
    for part in (turn < 3, (turn >= 2) & (turn < 6), turn >= 6):
        edits, state = continue_edits(revisions.filter(part), read_state(spark, path))
        edits = edit_columns(edits)
        found = found.union(edits) if found else edits
        write_state(state, path)
    return found


@query
def edits_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits_per_section(changed_sections(views.revisions(spark, sf_dir)))


@query
def sections_by_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections_per_article(changed_sections(views.revisions(spark, sf_dir)))


@query
def edit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = views.source_edits(spark, sf_dir).select("article", "ts", "rev_id", "section")
    ordered = number_rows(edits, ["article"], ["ts", "rev_id"])
    return ordered.select("article", "seq", "rev_id", seconds().alias("ts_seconds"), "section")


# Similarity


@query
def title_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    within = Window.partitionBy("article", "rev_id").orderBy("pos")
    titles = split_sections(views.revisions(spark, sf_dir)).select(
        "article",
        "rev_id",
        "pos",
        "section",
        F.lead("section").over(within).alias("next_section"),
    )
    similarity = title_similarity(F.col("section"), F.col("next_section"))
    return titles.filter(F.col("next_section").isNotNull()).select(
        "*", F.round(similarity, 6).alias("similarity")
    )


@query
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = vectors.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")
    )
    similarity = cosine(F.col("embedding"), F.col("other"))
    return vectors.join(following, "vec_id").select(
        "vec_id", F.round(similarity, 6).alias("similarity")
    )


@query
def mean_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    embed = views.embedding(spark, sf_dir)
    turns = views.turn_edits(spark, sf_dir).select("article", "seq", "content")
    return embed(turns).select("article", "seq", F.posexplode("vec").alias("dim", "x")).select(
        "article", "seq", "dim", F.round(F.col("x").cast("double"), 6).alias("x")
    )


@query
def mean_embedding_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``mean_embedding``, with room for the most frequent tokens only; all others are joined."""
    vectors = cut_lineage(views.word_vectors(spark, sf_dir), "vectors")
    embed = word_vector_embedding(vectors, table_limit=JOINED_LIMIT)
    turns = views.turn_edits(spark, sf_dir).select("article", "seq", "content")
    return embed(turns).select("article", "seq", F.posexplode("vec").alias("dim", "x")).select(
        "article", "seq", "dim", F.round(F.col("x").cast("double"), 6).alias("x")
    )


@query
def own_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's model in place of the word vectors, asked once for each distinct text."""

    @F.pandas_udf("array<float>")
    def sizes(texts: pd.Series) -> pd.Series:
        counts = zip(texts.str.len().astype(float), texts.str.count(" ").astype(float))
        return pd.Series([list(pair) for pair in counts], index=texts.index, dtype=object)

    turns = views.turn_edits(spark, sf_dir).select("article", "seq", "content")
    embed = stored_embedding(column_embedding(sizes), scratch_path(spark, "own-vectors"))
    return embed(turns).select(
        "article",
        "seq",
        F.get("vec", F.lit(0)).cast("double").alias("n_chars"),
        F.get("vec", F.lit(1)).cast("double").alias("n_spaces"),
    )


# Linking


def linked_columns(linked: DataFrame) -> DataFrame:
    return linked.select(
        "article",
        "seq",
        "section",
        "match_type",
        "match_distance",
        "prev_rev_id",
        "prev_section",
        digest("prev_content").alias("prev_md5"),
    )


def linked_revisions(spark: SparkSession, sf_dir: str, **settings: float) -> DataFrame:
    revisions = written_revisions(spark, sf_dir)
    linked = link_revisions(revisions, views.embedding(spark, sf_dir), **settings)
    # What was found in them is written.
    drop_tables(revisions)
    return linked


@query
def link_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_columns(linked_revisions(spark, sf_dir))


@query
def link_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_columns(linked_revisions(spark, sf_dir, content_threshold=NEVER))


@query
def link_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = linked_revisions(spark, sf_dir, title_threshold=NEVER)
    return linked_columns(linked.filter(F.col("section") != TOP))


@query
def link_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = linked_revisions(spark, sf_dir)
    return linked_columns(linked.filter(F.col("section") == TOP))


def numbered_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long histories: each source is one article."""
    edits = views.source_edits(spark, sf_dir)
    keys = edits.select("article", "ts", "rev_id")
    numbers = number_rows(keys, ["article"], ["ts", "rev_id"]).select("article", "rev_id", "seq")
    return cut_lineage(edits.join(numbers, ["article", "rev_id"]), "edits", codec="zstd")


@query
def link_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long histories and a short look-back."""
    edits = numbered_edits(spark, sf_dir)
    return linked_columns(link_edits(edits, views.embedding(spark, sf_dir), lookback=LOOKBACK))


@query
def link_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_columns(
        link_edits(views.turn_edits(spark, sf_dir), views.embedding(spark, sf_dir))
    )


@query
def link_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long histories and the look-back that is usual."""
    return linked_columns(link_edits(numbered_edits(spark, sf_dir), views.embedding(spark, sf_dir)))


def linked_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_revision_types(written_revisions(spark, sf_dir), views.embedding(spark, sf_dir))


@query
def link_type_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_types(spark, sf_dir).select(
        "article", "seq", "section", "match_type", "match_distance", "is_first_time"
    )


@query
def match_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = match_type_stats(linked_types(spark, sf_dir))
    return stats.withColumn("percent", F.round("percent", 6))


@query
def match_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = match_distance_stats(linked_types(spark, sf_dir))
    return stats.withColumn("avg_distance", F.round("avg_distance", 6))


@query
def linking_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking_stats(changed_sections(views.revisions(spark, sf_dir)), 0.8, 0.99, 1000)


# Prompts


def prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_prompts(
        linked_revisions(spark, sf_dir), bundled_taxonomy(spark), bundled_taxonomy(spark, True)
    )


@query
def taxonomy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = views.revisions(spark, sf_dir).select("article").distinct()
    article = F.col("article")
    return (
        articles.withColumn("_rows", taxonomy_lines(bundled_taxonomy(spark)))
        .withColumn("_first_rows", taxonomy_lines(bundled_taxonomy(spark, True)))
        .select(
            "article",
            labels_text(F.col("_rows"), article).alias("compare_labels"),
            labels_text(F.col("_first_rows"), article).alias("first_time_labels"),
        )
    )


def prompt_columns(prompts: DataFrame) -> DataFrame:
    return prompts.select(
        "custom_id",
        F.length("prompt").alias("n_chars"),
        digest("prompt").alias("prompt_md5"),
    )


@query
def prompts_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt_columns(prompt_rows(spark, sf_dir).filter(~F.col("is_first_time")))


@query
def prompts_first_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt_columns(prompt_rows(spark, sf_dir).filter("is_first_time"))


@query
def prompt_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        linked_types(spark, sf_dir)
        .groupBy("match_type", "is_first_time")
        .agg(F.count(F.lit(1)).alias("n_prompts"))
    )


# Answers


def parsed_answers(
    spark: SparkSession, sf_dir: str, forms: list[str] = views.ANSWERS
) -> DataFrame:
    return parse_answers(views.answers(spark, sf_dir, forms), bundled_taxonomy(spark))


def answer_columns(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "doc_id", joined().alias("labels"), explained().alias("explanations"), "parse_status"
    )


@query
def parse_json_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_columns(parsed_answers(spark, sf_dir, views.JSON_ANSWERS))


@query
def parse_text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_columns(parsed_answers(spark, sf_dir, views.TEXT_ANSWERS))


@query
def parse_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_columns(parsed_answers(spark, sf_dir))


@query
def parse_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_rate(parsed_answers(spark, sf_dir))


@query
def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = failed_answers(parsed_answers(spark, sf_dir))
    return failed.select("doc_id", digest("response").alias("response_md5"))


@query
def parse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as answers: long texts of any content must be refused, not fail the job."""
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    parsed = parse_answers(documents, bundled_taxonomy(spark), "text")
    return parsed.groupBy("source", "parse_status").agg(F.count(F.lit(1)).alias("n"))


@query
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parsed_answers(spark, sf_dir)
    # Outer, as the plain form would parse every answer again to find the empty ones.
    counts = parsed.select(F.explode_outer("labels").alias("label")).groupBy("label").count()
    names = taxonomy_names(bundled_taxonomy(spark)).withColumnRenamed("name", "category")
    return (
        counts.join(names, "label")
        .join(F.broadcast(label_names(spark)), "label")
        .select("label", "name", "category", F.col("count").alias("n"))
    )


# Exchange and output


@query
def api_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages saved out of order: the source order follows the files, not the revision ids."""
    path = scratch_path(spark, "api")
    saved = views.revisions(spark, sf_dir).orderBy("article", F.col("rev_id") % 3, "rev_id")
    write_api_pages(saved, path)
    revisions = revisions_from_pages(read_api_pages(spark, path, multi_line=False))
    narrow = revisions.select(
        "article",
        "rev_id",
        seconds().alias("ts_seconds"),
        "user",
        F.length("wikitext").alias("n_chars"),
        digest("wikitext").alias("text_md5"),
        F.col("rev_seq").alias("place"),
    )
    return number_rows(narrow, ["article"], ["place"], "rev_seq").drop("place")


@query
def overlapping_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response repeats the next one's revision with an early text; some entries have no id."""
    doc = F.col("doc_id")

    def entry(rev_id: Column, text: Column) -> Column:
        content = F.struct(F.struct(text.alias("*")).alias("main")).alias("slots")
        return F.to_json(F.struct(rev_id.alias("revid"), content))

    text = F.coalesce("text", F.lit(""))
    # A quoted number makes the response one that is read entry by entry.
    own = F.when(doc % 6 == 1, entry(doc.cast("string"), text)).otherwise(entry(doc, text))
    early = entry(doc + 1, F.concat(F.lit("early "), (doc + 1).cast("string")))
    lost = F.when(doc % 4 == 0, entry(F.lit(None).cast("long"), text))
    response = F.concat(
        F.lit('{"query":{"pages":{"5":{"title":"T","revisions":['), F.concat_ws(",", lost, own, early), F.lit("]}}}}")
    )
    path = scratch_path(spark, "overlapping")
    saved = views.table(spark, sf_dir, "documents").select("doc_id", response.alias("value"))
    saved.repartitionByRange(FILES, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    scan = scan_pages(read_api_pages(spark, path, multi_line=False))
    found = scan.revisions.select(F.lit("revision").alias("kind"), "rev_id", digest("wikitext").alias("text_md5"))
    other = scan.conflicts.select(F.lit("conflict"), "rev_id", digest("wikitext"))
    bad = scan.corrupt.select(F.lit("corrupt"), F.lit(None).cast("long"), digest("article"))
    return found.union(other).union(bad)


@query
def empty_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No page asked for exists: the chain goes through without rows."""
    path = scratch_path(spark, "missing")
    response = F.concat(
        F.lit('{"query":{"pages":{"-1":{"title":"'), F.md5("text"), F.lit('","missing":""}}}}')
    )
    views.table(spark, sf_dir, "documents").select(response.alias("value")).write.text(path)
    pages = read_api_pages(spark, path, multi_line=False)
    linked = link_revisions(revisions_from_pages(pages), views.embedding(spark, sf_dir))
    prompts = build_prompts(linked, bundled_taxonomy(spark), bundled_taxonomy(spark, True))
    n_prompts = prompts.agg(F.count(F.lit(1)).alias("n_prompts"))
    return pages.filter(F.col("query").isNotNull()).agg(F.count("query").alias("n_pages")).join(
        F.broadcast(n_prompts), F.lit(True)
    )


@query
def taxonomy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxonomy in several files, with whole documents as definitions; later rows replace earlier."""
    path = scratch_path(spark, "taxonomy")
    doc = F.col("doc_id")
    rows = views.table(spark, sf_dir, "documents").select(
        "doc_id",
        (doc % 150).cast("int").alias("#"),
        F.concat(F.lit('"Kind", '), doc.cast("string")).alias("Category Name"),
        F.coalesce("text", F.lit("")).alias("Definition"),
        F.col("source").alias("Example"),
    )
    # A file whose cells hold line breaks is read by one task, so their number is left to Spark.
    files = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").drop("doc_id")
    files.write.options(**CSV_OPTIONS).csv(path)
    return read_taxonomy(spark, path).select(
        "label", "category", digest("definition").alias("definition_md5"), "example"
    )


@query
def partial_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two revisions a response, every third time a third one with a bad id; some pages are missing."""
    doc = F.col("doc_id")
    text = F.struct(F.struct(F.coalesce("text", F.lit("")).alias("*")).alias("main")).alias("slots")

    def entry(rev_id: Column) -> Column:
        return F.to_json(F.struct(rev_id.alias("revid"), F.lit("u").alias("user"), text))

    entries = F.concat_ws(
        ",", entry(2 * doc), F.when(doc % 3 == 0, entry(F.lit("x"))), entry(2 * doc + 1)
    )
    page_id = F.when(doc % 7 == 6, "-1").otherwise("5")
    response = F.concat(
        F.lit('{"requested":"Asked","query":{"pages":{"'), page_id, F.lit('":{'),
        F.when(doc % 5 > 0, '"title":"T",').otherwise(""), F.lit('"revisions":['), entries, F.lit("]}}}}"),
    )
    path = scratch_path(spark, "partial")
    views.table(spark, sf_dir, "documents").select(response.alias("value")).write.text(path)
    found = revisions_from_pages(read_api_pages(spark, path, multi_line=False))
    return found.select("article", "rev_id", digest("wikitext").alias("text_md5"))


def source_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("custom_id"), F.col("text").alias("prompt")
    )


@query
def batch_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests written as JSON lines and read back."""
    path = scratch_path(spark, "requests")
    write_requests(source_prompts(spark, sf_dir), path, "some-model")
    message = F.get("body.messages", F.lit(0))
    return read_requests(spark, path).select(
        "custom_id",
        "method",
        "url",
        F.col("body.model").alias("model"),
        message["role"].alias("role"),
        F.md5(message["content"]).alias("prompt_md5"),
    )


@query
def response_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written as JSON lines, read back and joined to the prompts, which outnumber them."""
    path = scratch_path(spark, "responses")
    message = F.struct(F.struct(F.col("response").alias("content")).alias("message"))
    body = F.struct(F.struct(F.array(message).alias("choices")).alias("body"))
    line = F.to_json(F.struct("custom_id", body.alias("response")))
    views.answers(spark, sf_dir).select(line.alias("value")).write.text(path)
    responses = read_responses(spark, path)
    answered = join_responses(source_prompts(spark, sf_dir), responses)
    return answered.select("custom_id", "response", digest("prompt").alias("prompt_md5"))


@query
def repeated_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of several runs in several files; of the same id the last one counts."""
    path = scratch_path(spark, "repeated")
    doc = F.col("doc_id")
    message = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    body = F.struct(F.struct(F.array(message).alias("choices")).alias("body"))
    line = F.to_json(F.struct((doc % 150).cast("string").alias("custom_id"), body.alias("response")))
    lines = views.table(spark, sf_dir, "documents").select("doc_id", line.alias("value"))
    files = lines.repartitionByRange(FILES, "doc_id").sortWithinPartitions("doc_id")
    files.select("value").write.text(path)
    return read_responses(spark, path).select("custom_id", digest("response").alias("response_md5"))


@query
def resumed_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that fails for every third length of prompt at first; a second run asks for these only."""
    path = scratch_path(spark, "ledger")
    prompts = source_prompts(spark, sf_dir)

    def hesitant(texts: pd.Series) -> pd.Series:
        sizes = texts.str.len()
        return ("first " + sizes.astype(str)).where(sizes % 3 > 0, None)

    resumed_score(prompts, hesitant, path)
    answers = resumed_score(prompts, lambda texts: "second " + texts.str.len().astype(str), path)
    tries = read_ledger(spark, path).groupBy("custom_id").agg(F.count(F.lit(1)).alias("n_asked"))
    return answers.join(tries, "custom_id")


@query
def batch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error file with one line per labelled document, of which the toxic ones failed."""
    path = scratch_path(spark, "errors")
    error = F.when(F.col("toxic") == 1, F.struct(F.lit("blocked").alias("code")))
    line = F.struct(F.col("doc_id").cast("string").alias("custom_id"), error.alias("error"))
    labels = views.table(spark, sf_dir, "labels")
    labels.select(F.to_json(line).alias("value")).write.text(path)
    return read_errors(spark, path)


@query
def scored_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts answered by a model function, and the answers parsed."""

    def model(prompts: pd.Series) -> pd.Series:
        sizes = prompts.str.len()
        labels = (1 + sizes % 10).astype(str)
        return '{"' + labels + '": "' + sizes.astype(str) + ' characters"}'

    parsed = parse_answers(score(source_prompts(spark, sf_dir), model), bundled_taxonomy(spark))
    return parsed.select("custom_id", joined().alias("labels"), explained().alias("explanations"))


@query
def chain_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match types, distances and parse rate, all from the run that writes the labelled history."""
    linked, links = observed_links(linked_revisions(spark, sf_dir))
    parsed, answers = observed_answers(answered_prompts(spark, sf_dir, linked))
    # Prompts are written, and hold the texts.
    drop_tables(linked)
    write_parquet(labelled_edits(parsed), scratch_path(spark, "labelled"), codec="zstd")
    figures = link_figures(links)
    types = [(kind, n) for kind, n in figures.pop("types").items()]
    rows = [*types, *((name, value) for name, value in (figures | answers.get).items())]
    return spark.createDataFrame([(name, float(value)) for name, value in rows], "figure string, value double")


def answered_prompts(spark: SparkSession, sf_dir: str, linked: DataFrame) -> DataFrame:
    taxonomy = bundled_taxonomy(spark)
    prompts = prompts_for_model(linked, taxonomy, bundled_taxonomy(spark, True))
    answers = views.answers(spark, sf_dir).select(F.col("doc_id").alias("rev_id"), "response")
    responses = prompts.select("custom_id", "rev_id").join(answers, "rev_id")
    return parse_answers(join_responses(prompts, responses), taxonomy)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain. The answer to a prompt is built from the labels of the edit's document."""
    taxonomy = bundled_taxonomy(spark)
    linked = linked_revisions(spark, sf_dir)
    prompts = prompts_for_model(linked, taxonomy, bundled_taxonomy(spark, True))
    answers = views.answers(spark, sf_dir).select(F.col("doc_id").alias("rev_id"), "response")
    responses = prompts.select("custom_id", "rev_id").join(answers, "rev_id")
    return label_edits(prompts, responses, taxonomy)


def labelled_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "article",
        "section",
        "rev_id",
        seconds().alias("ts_seconds"),
        "user",
        digest("prev_content").alias("prev_md5"),
        digest("content").alias("content_md5"),
        joined().alias("labels"),
        explained().alias("explanations"),
    )


@query
def labelled_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_columns(labelled(spark, sf_dir))


@query
def published_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's result written as CSV and read back."""
    path = scratch_path(spark, "labelled")
    write_csv(labelled(spark, sf_dir), path)
    return labelled_columns(read_csv(spark, path))
