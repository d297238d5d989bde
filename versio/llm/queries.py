"""Registered queries of the training-data operators: each applies its
operator with production parameters to the whole tables. ``None`` instead of
SQL means that SQL cannot express the method; ``tests/llm`` then holds the
query against a brute-force version."""

from pyspark.sql import functions as F

from . import ann as AN
from . import chat as CH
from . import decontamination as DC
from . import langid as LI
from . import line_dedup as LD
from . import oracles as O
from . import quality as Q
from . import repair as RP
from . import sentencepiece as SP
from . import simhash as SH
from . import toxicity as TX
from . import url_filter as UF
from . import warc as WA
from . import whitening as WH
from .common import checked_broadcast

#: Vocabulary file of a public tokenizer, installed on every node.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

_REGISTRY: dict = {}


def query(name: str, sql=None):
    def wrap(fn):
        _REGISTRY[name] = (fn, sql)
        return fn
    return wrap


def registry() -> dict:
    return dict(_REGISTRY)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Term families (fixed values) that refine the one toxic label of ``labels``
#: into categories for the chain to learn; predictions never look at them.
TOXIC_FAMILIES = {"insult": ["clown", "idiot", "loser", "moron", "scum"],
                  "contempt": ["disgusting", "pathetic", "stupid", "trash", "worthless"]}


def toxic_labels(docs, labels):
    """``doc_id`` and the 0/1 categories toxic, insult and contempt."""
    known = docs.select("doc_id", "text").join(checked_broadcast(labels.select("doc_id", "toxic").where("toxic is not null")), "doc_id")
    return known.select("doc_id", "toxic", *[
        F.when((F.col("toxic") == 1) & F.lower("text").rlike(r"\b(" + "|".join(words) + r")\b"), 1).otherwise(0).alias(name)
        for name, words in TOXIC_FAMILIES.items()])


@query("op1_toxicity_chain")
def q_toxicity(spark, sf_dir):
    """Probability of each category for every document, and whether it is toxic."""
    docs = _table(spark, sf_dir, "documents")
    labels = toxic_labels(docs, _table(spark, sf_dir, "labels"))
    out = TX.toxicity(docs.select("doc_id", "text"), labels, ["toxic", *TOXIC_FAMILIES])
    return out.select("doc_id", *[F.col("toxicity")[c].alias(f"p_{c}") for c in ["toxic", *TOXIC_FAMILIES]],
                      (F.col("toxicity")["toxic"] >= 0.5).alias("toxic"))


@query("op2_winnowing_decontamination", O.DECONTAMINATION)
def q_decontamination(spark, sf_dir):
    """Words of each document inside 13-word windows of benchmark items."""
    docs = DC.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    ids = F.array_sort(F.transform(F.filter(c["items"], lambda x: x.isNotNull()), lambda x: x.cast("string")))
    return docs.select("doc_id", c["n_words"].cast("long").alias("n_words"), c["n_hit"].cast("long").alias("n_hit"),
                       F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                       c["contaminated"].alias("contaminated"))


@query("op3_sentencepiece_fst")
def q_sentencepiece(spark, sf_dir):
    """Piece ids of every whole text, and whether they decode to it again (a
    literal meta symbol counts as a space, as in the model)."""
    sp = SP.SentencePiece(spark, PIECE_MODEL)
    docs = _table(spark, sf_dir, "documents").select("doc_id", sp.encode_and_check(F.col("text")).alias("p"))
    return docs.select("doc_id", "p.ids", F.size("p.ids").alias("n_ids"), F.col("p.same").alias("round_trip"))


@query("op4_bloom_cascade_urls", O.URL_FILTER)
def q_urls(spark, sf_dir):
    """Verdict on every page's URL: rules, else the listed keys (some fixed
    domains, and a sixteenth of the hosts and of the hosts with path)."""
    pages = _table(spark, sf_dir, "pages")
    host, path = UF.split_url(F.col("url"))
    keys = pages.select(host.alias("host"), path.alias("path")).where("host != ''").select(
        F.explode(F.array(F.col("host"), F.concat("host", "path"))).alias("key"))
    listed = keys.where(F.startswith(F.md5("key"), F.lit(O.LISTED_MD5))).unionByName(
        spark.createDataFrame([(d,) for d in O.LISTED_DOMAINS], "key string")).distinct()
    return UF.judge_urls(pages, listed, O.URL_RULES).select("page_id", "judged.*")


@query("op5_perspective_rotation", O.CHAT)
def q_chat(spark, sf_dir):
    """Every conversation from the perspective of each of its speakers."""
    return CH.rotate(_table(spark, sf_dir, "conversations"))


@query("op6_simhash_near_dedup")
def q_simhash(spark, sf_dir):
    """SimHash groups of all documents: 3-word shingles, at most 2 bits."""
    return SH.simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


@query("op7_quality_empirical_bayes")
def q_quality(spark, sf_dir):
    """Quality posterior of every document: text evidence, host (source) and
    path (source and language) posteriors, and whether it is kept."""
    docs = _table(spark, sf_dir, "documents")
    return Q.score_documents(docs, _table(spark, sf_dir, "labels")).select("doc_id", "quality_score.*")


@query("op8_collision_counting_ann")
def q_ann(spark, sf_dir):
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    vectors = _table(spark, sf_dir, "embeddings")
    return AN.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query("op9_centroid_language_id")
def q_language(spark, sf_dir):
    """Language of every document, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = LI.train(docs.where(fold != 0).select("text", "lang"))
    out = LI.predict(docs.select("doc_id", "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out")), model)
    return out.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), "language.score",
                      F.col("language.rejected").alias("rejected"))


@query("op10_line_dedup")
def q_line_dedup(spark, sf_dir):
    """All documents without repeated lines: doc_id, text, n_lines, n_removed."""
    return LD.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query("op11_sharded_warc", O.WARC)
def q_warc(spark, sf_dir):
    """Every page as a record of sharded WARC files, as read back from them."""
    pages = _table(spark, sf_dir, "pages")
    id_type = pages.schema["page_id"].dataType
    out = WA.archive(pages)
    return out.select(F.col("page").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                      F.col("refers_to").cast(id_type).alias("refers_to"))


@query("op12_jacobi_davidson_whitening")
def q_whitening(spark, sf_dir):
    """Every vector along the four leading components of the distinct vectors, whitened."""
    out = WH.whiten(_table(spark, sf_dir, "embeddings"), components=4, scale=256)
    return out.select(F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened",
                      "explained", "identity_error")


def damaged(turns):
    """``conversations`` damaged by the hash of conversation and turn, and how
    often each row then comes: one row in twenty each is dropped, emptied,
    stripped of its sentence marks, repeated, or made the user's."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind, text = F.crc32(key) % 20, F.coalesce("text", F.lit(" "))
    return turns.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"))


@query("op13_ida_star_repair")
def q_repair(spark, sf_dir):
    """Faults and cheapest repair of every damaged conversation."""
    turns = _table(spark, sf_dir, "conversations")
    rows, done = RP.repair(damaged(turns), copies_col="copies")
    return RP.report(rows, done, turns)
