"""Free-entered values to the entries of a reference list: a prefix-filter set-similarity join.

Different values are normalised and split into padded q-grams once. Grams are ordered by global rarity; two
sets of Jaccard similarity t share a gram within their first |x| - ceil(t|x|) + 1, so only those prefixes
are joined. Length and positional filters thin the candidates, Jaccard is verified exactly, and the best
entry by edit similarity (with abbreviations and reordered words) is kept if it is similar enough.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from sheafwork.llm.strings import abbreviates, fold, grams, similarity

JACCARD = 0.2  #: candidates share at least this part of their grams
LIKE = 0.71  #: an entry is meant from this similarity on
Q = 2
# Additions that do not change the entry.
_ADDED = re.compile(
    r"\((?!s\))[^)]*\)|\[[^\]]*\]|\b(?:excl|incl)\.?\s*(?:vat|tax)\b\.?|\bhors taxes?\b|\b(?:usd|eur|gbp|zar|mur|inr|aed)\b|,?\s*\bregion\s+\d+\b|^(?:city|town|port city) of\s+|\s+town\b"
    r"|^by\s+|\s+brand\b|\s+(?:inc|ltd|co|llc|gmbh)\b\.?$|^(?:senior|junior|acting|deputy)\s+|\b\d{4,6}\b|[*:®™]"
)
_PARTS = re.compile(r"[a-z0-9]+'?[a-z0-9]*\.?|%")


def normal(text: str) -> str:
    """A value without additions: folded words, one space apart, a full stop kept at the end of a word as sign of an abbreviation."""
    folded = fold(text)
    bare = _ADDED.sub(" ", folded)
    words = _PARTS.findall(bare) or _PARTS.findall(folded)
    return " ".join(w.replace("'", "") for w in words)


def likeness(value: str, entry: str) -> float:
    """Similarity of two normal values: letters in order, letters of sorted words, or words one by one with abbreviations."""
    xs, ys = value.replace(".", "").split(), entry.replace(".", "").split()
    x, y = "".join(xs), "".join(ys)
    best = max(similarity(x, y), similarity("".join(sorted(xs)), "".join(sorted(ys))) if len(xs) > 1 and len(ys) > 1 else 0.0)
    if len(xs) == len(ys) > 0 and best < 1:
        for order in (xs, xs[1:] + xs[:1], xs[::-1]):
            total = hit = 0.0
            for a, b in zip(order, ys):
                s = similarity(a, b)
                if s < 0.75 and (abbreviates(a, b) or (len(a) == 1 and b.startswith(a))):
                    s, hit = 0.9, 1.0
                total += s * len(b)
            if hit:
                best = max(best, total / len(y))
    return best


_NORMAL = StructType([StructField("norm", StringType()), StructField("grams", ArrayType(StringType()))])


@F.pandas_udf(_NORMAL)
def _normal(texts: pd.Series) -> pd.DataFrame:
    norms = [normal(t) for t in texts]
    return pd.DataFrame({"norm": norms, "grams": [grams(n.replace(" ", "").replace(".", ""), Q) for n in norms]})


_normal = _normal.asNondeterministic()  # else filters on its result are pushed below the grouping and normalise every row


@F.pandas_udf(DoubleType())
def _likeness(values: pd.Series, entries: pd.Series) -> pd.Series:
    return pd.Series([likeness(a, b) for a, b in zip(values, entries)], dtype="float64")


def _ordered(sets: DataFrame, rarity: DataFrame, key: str, threshold: float) -> DataFrame:
    """One row per prefix gram: list_name, key, n (set size), pos (place in rarity order), gram, and the whole set."""
    ranked = sets.select("list_name", key, "grams", F.explode("grams").alias("gram")).join(rarity, ["list_name", "gram"])
    lists = ranked.groupBy("list_name", key).agg(F.first("grams").alias("grams"), F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("__o"))
    n = F.size("__o")
    prefix = lists.withColumns({"n": n, "__p": F.slice("__o", F.lit(1), F.greatest(n - F.ceil(n * threshold).cast("int") + 1, F.lit(1)))})
    return prefix.select("list_name", key, "n", "grams", F.posexplode("__p").alias("pos", "__g")).withColumn("gram", F.col("__g.gram")).drop("__g")


def map_values(values: DataFrame, entries: DataFrame, threshold: float = JACCARD, like: float = LIKE) -> DataFrame:
    """Every row of `values` (list_name, text and any other columns) with `entry_id`, -1 where no entry is meant.

    `entries` has entry_id, list_name, canonical, aliases. Equal texts are matched once, so a frequent text
    costs nothing more. Null text gives -1, as does a blank one. Of equally similar entries the one with the
    higher Jaccard similarity, then the smaller entry_id is kept. Rows are neither lost nor repeated.
    """
    names = entries.select("entry_id", "list_name", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).where("name is not null")
    known = names.withColumn("__n", _normal("name")).select("entry_id", "list_name", F.col("__n.norm").alias("entry"), F.col("__n.grams").alias("grams")).where("size(grams) > 0")
    known = known.groupBy("list_name", "entry").agg(F.min("entry_id").alias("entry_id"), F.first("grams").alias("grams")).withColumn("yk", F.concat_ws("\u0001", "entry_id", "entry"))
    texts = values.where("text is not null").select("list_name", "text").distinct().withColumn("__n", _normal("text"))
    texts = texts.select("list_name", "text", F.col("__n.norm").alias("norm"), F.col("__n.grams").alias("grams"))
    different = texts.where("size(grams) > 0").groupBy("list_name", "norm").agg(F.first("grams").alias("grams"))
    every = different.select("list_name", "grams").unionByName(known.select("list_name", "grams"))
    rarity = every.select("list_name", F.explode("grams").alias("gram")).groupBy("list_name", "gram").agg(F.count("*").alias("df"))
    x, y = _ordered(different, rarity, "norm", threshold), _ordered(known, rarity, "yk", threshold)
    y = y.select("list_name", "gram", "yk", F.col("n").alias("m"), F.col("pos").alias("at"), F.col("grams").alias("entry_grams"))
    need = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("m"))
    bound = F.least("pos", "at") + 1 + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at")) - 1
    close = (F.col("m") >= F.col("n") * threshold) & (F.col("m") * threshold <= F.col("n")) & (bound >= need)
    pairs = x.join(y, ["list_name", "gram"]).where(close).groupBy("list_name", "norm", "yk").agg(F.first("grams").alias("grams"), F.first("entry_grams").alias("entry_grams"))
    shared = F.size(F.array_intersect("grams", "entry_grams"))
    jaccard = shared / (F.size("grams") + F.size("entry_grams") - shared)
    pairs = pairs.withColumn("jaccard", jaccard).where(F.col("jaccard") >= threshold)
    parts = F.split("yk", "\u0001")
    scored = pairs.select("list_name", "norm", "jaccard", parts[0].cast("long").alias("entry_id"), parts[1].alias("entry")).withColumn("like", _likeness("norm", "entry"))
    best = scored.where(F.col("like") >= like).groupBy("list_name", "norm").agg(F.max_by("entry_id", F.struct("like", "jaccard", -F.col("entry_id"))).alias("entry_id"))
    found = texts.select("list_name", "text", "norm").join(best, ["list_name", "norm"]).select("list_name", "text", "entry_id")
    keep = [F.col(c) for c in values.columns if c != "entry_id"]
    return values.drop("entry_id").join(found, ["list_name", "text"], "left").select(*keep, F.coalesce("entry_id", F.lit(-1).cast("long")).alias("entry_id"))
