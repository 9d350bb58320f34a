"""Queries of the training-data operators (pN_...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheafwork.llm import canonical, confusables, listings, mixing, names, packing, subjects
from sheafwork.llm.tokens import token_count
from sheafwork.session import written
from sheafwork.sources.tables import latest, table


def _written_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "words").select(F.lit("word").alias("src"), F.col("word_id").alias("row_id"), "text")
    cells = latest(table(spark, sf_dir, "grid_cells").select("cell_id", "text", "loaded_at"), "cell_id")
    return words.unionByName(cells.select(F.lit("cell").alias("src"), F.col("cell_id").alias("row_id"), "text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and cells (each once) that differ from their consistent form, with that form."""
    return confusables.inconsistent(_written_texts(spark, sf_dir)).select("src", "row_id", "clean")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of words and cells that look alike but differ in characters."""
    return confusables.look_alike_groups(_written_texts(spark, sf_dir))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "line_items").select(F.col("supplier").alias("name"))
    return lines.unionByName(table(spark, sf_dir, "quote_headers").select(F.col("supplier").alias("name")))


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different supplier string with the key of its cluster."""
    return names.link_names(_suppliers(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different supplier strings that name one firm or person."""
    member = names.link_names(_suppliers(spark, sf_dir))
    a, b = member.select("cluster", F.col("name").alias("name_a")), member.select("cluster", F.col("name").alias("name_b"))
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place, maker and job-title cell (each once) and every heading with the entry it means, or -1."""
    cells = latest(table(spark, sf_dir, "grid_cells").select("cell_id", "cell_role", "text", "loaded_at"), "cell_id")
    once = cells.where("cell_role in ('place', 'maker', 'job_title') and text is not null").select(F.lit("cell").alias("src"), F.col("cell_id").alias("row_id"), F.lit(0).alias("pos"), F.col("cell_role").alias("list_name"), "text")
    heads = table(spark, sf_dir, "table_locations").select(F.col("loc_id").alias("row_id"), F.posexplode("column_heads").alias("pos", "text")).where("text is not null")
    values = once.unionByName(heads.select(F.lit("location").alias("src"), "row_id", "pos", F.lit("template_field").alias("list_name"), "text"))
    return canonical.map_values(values, table(spark, sf_dir, "ref_entries")).select("src", "row_id", "pos", "entry_id")


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "line_items").select("item_id", F.col("supplier").alias("seller"), "description", "ref", "loaded_at")
    entries = table(spark, sf_dir, "ref_entries").where("list_name = 'maker'")
    return listings.match_listings(latest(lines, "item_id"), entries.select(F.col("canonical").alias("name")))


def p1_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable line with the article it offers, how it came to it, and the number of other lines of that article."""
    member = written(_articles(spark, sf_dir), "articles")
    return member.join(member.groupBy("article").agg((F.count("*") - 1).alias("links")), "article")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items that are one article."""
    member = written(_articles(spark, sf_dir), "articles")
    a, b = member.select("article", F.col("item_id").alias("item_a")), member.select("article", F.col("item_id").alias("item_b"))
    return a.join(b, "article").where("item_a < item_b").select("item_a", "item_b")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in containers of every pack."""
    return packing.pack(written(_sizes(spark, sf_dir), "sizes"), table(spark, sf_dir, "pack_sizes"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, fill and lower bound of every pack."""
    return packing.fill_report(p7_containers(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "subject_labels").select("doc_id", "subject")
    return subjects.assign_subjects(docs, table(spark, sf_dir, "subject_areas"), labels)


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = _subjects(spark, sf_dir).groupBy("doc_id").agg(F.max_by("subject", F.struct("hits", "subject")).alias("topic"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.lower(F.substring("lang", 1, 2)).alias("lang"), token_count(F.col("text")).alias("tokens"))
    return mixing.mix(docs.join(topic, "doc_id", "left"), table(spark, sf_dir, "mix_targets"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of copies in the mixture."""
    return _mixture(spark, sf_dir)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixing.mix_report(_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the subjects it is about."""
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by subject."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"))


QUERIES = {
    "p1_found": p1_found, "p1_articles": p1_articles,
    "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_clusters": p5_clusters, "p6_found": p6_found,
    "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_composition": p9_composition,
}
ORACLE: dict[str, str] = {}
