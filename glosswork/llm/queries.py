"""The queries of the training-data operators, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from ..tables import table
from . import split as splitting
from . import sql
from .clusters import CAP, complete_records, describe, similarity_groups
from .containers import divided, document_sizes, faults, fill, fill_report
from .cooccur import block_baskets, cooccurrence, document_baskets
from .encode import encode
from .frequency import token_frequency
from .neighbours import close_pairs, nearest, recall, search
from .residue import residue
from .split import oversized, piece_tokens, split


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of more than 1,024 current tokens and how they had to be cut."""
    return oversized(split(table(spark, sf_dir, "corpus"), table(spark, sf_dir, "vocab"), oversized_only=True))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces with their tokens."""
    return piece_tokens(table(spark, sf_dir, "corpus"), table(spark, sf_dir, "vocab"))


def p1_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document put together again from its pieces, and what is wrong with them."""
    return splitting.faults(p1_pieces(spark, sf_dir))


def _states(spark: SparkSession, sf_dir: str, cap: int = CAP) -> DataFrame:
    states = table(spark, sf_dir, "work_sample").select(F.lit(0).cast("bigint").alias("grp"), F.col("row_index").alias("id"), F.col("h").alias("vec"))
    return similarity_groups(states, 0.8, dim=64, cap=cap)


def _profiles(spark: SparkSession, sf_dir: str, cap: int = CAP) -> DataFrame:
    records = materialise(complete_records(table(spark, sf_dir, "responsibilities")), "profiles")
    return similarity_groups(records, 0.9, kind="f8", cap=cap)


def p2_found(spark: SparkSession, sf_dir: str, cap: int = CAP) -> DataFrame:
    """Hidden states and sense profiles in groups of at least five similar ones."""
    named = [(_states(spark, sf_dir, cap), "h"), (_profiles(spark, sf_dir, cap), "responsibilities")]
    h, r = (g.select(F.lit(name).alias("field"), F.col("id").alias("row_index"), "group_key") for g, name in named)
    return h.unionByName(r)


def p2_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with cells of at most 128 records, as a larger table would have them for its size."""
    return p2_found(spark, sf_dir, cap=128)


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups with their size and three most typical members."""
    named = [(_states(spark, sf_dir), "h"), (_profiles(spark, sf_dir), "responsibilities")]
    h, r = (describe(g).select(F.lit(name).alias("field"), "grp", "group_key", "size", "typical") for g, name in named)
    return h.unionByName(r)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that are too rare or too common."""
    return p3_frequency(spark, sf_dir).where("mark IS NOT NULL").select("token", "mark")


def p3_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency and document frequency of every current token."""
    return token_frequency(table(spark, sf_dir, "corpus"), table(spark, sf_dir, "vocab"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tokens in at least 15 common blocks, at least ten times as often as by chance."""
    return p4_pairs(spark, sf_dir).select(F.col("item_a").alias("token_a"), F.col("item_b").alias("token_b"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with their counts and association scores."""
    baskets = block_baskets(table(spark, sf_dir, "corpus"), table(spark, sf_dir, "vocab"))
    return cooccurrence(baskets, ["doc_id", "block"], least=15, lift=10.0)


def p4_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tokens in at least five common documents, at least ten times as often as by chance; long documents are large baskets."""
    baskets = document_baskets(table(spark, sf_dir, "corpus"), table(spark, sf_dir, "vocab"))
    return cooccurrence(baskets, ["doc_id"], least=5, lift=10.0)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embedding").select(F.col("emb_id").alias("id"), F.col("e").alias("vec"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of cosine 0.9 or more, one among the five nearest of the other."""
    return close_pairs(nearest(_vectors(spark, sf_dir), k=5, dim=48, least=0.9))


def _asked(vectors: DataFrame) -> DataFrame:
    """The query set of searches: every row whose id is divisible by 100."""
    return vectors.where("id % 100 = 0")


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar of all vectors for every hundredth one, however far they are."""
    vectors = _vectors(spark, sf_dir)
    return search(vectors, _asked(vectors), k=5, dim=48).withColumnsRenamed({"id": "emb_id"})


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the forest finds nine tenths of what brute force over all vectors finds."""
    vectors = _vectors(spark, sf_dir)
    found, exact = (search(vectors, _asked(vectors), k=5, dim=48, exact=e) for e in (False, True))
    return recall(found, exact, 0.9)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents larger than a container."""
    return divided(p7_containers(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or piece of one."""
    return fill(document_sizes(table(spark, sf_dir, "documents")))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(p7_containers(spark, sf_dir))


def p7_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the containers: nothing."""
    sizes = document_sizes(table(spark, sf_dir, "documents"))
    return faults(fill(sizes), sizes)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are residue of templates or pages."""
    return residue(table(spark, sf_dir, "documents")).select("doc_id")


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All other documents."""
    documents = table(spark, sf_dir, "documents")
    return documents.join(p8_found(spark, sf_dir), "doc_id", "left_anti")


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_whole, p2_found, p2_cells, p2_groups, p3_found, p3_frequency, p4_found, p4_pairs, p4_large, p5_found, p5_nearest, p5_recall, p6_ids, p7_found, p7_containers, p7_fill, p7_whole, p8_found, p8_kept)}
ORACLES = sql.ORACLES
