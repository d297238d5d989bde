"""Registered queries: one per operator of the inventory, each a function
``(spark, sf_dir) -> DataFrame`` over the shared test tables, with the
DuckDB SQL that must give the same rows (``None`` = rows-only check).

Parameters follow the recorded demo run of the experiment where they
matter (seed 42, batch 8, 20 decoded rows) and the default configuration otherwise (sequence length 128).
"""

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.text import pre_tokenize
from ..operators import encoding as E
from ..operators import history as H
from ..operators import hypotheses as Y
from ..operators import inputs as I
from ..operators import losses as L
from ..operators import manifest as M
from ..operators import metrics as X
from ..operators import sampling as S
from ..operators import vocab as V
from ..operators.partitioning import pieces, spread_rows
from ..session import ensure_checkpoint_dir
from ..sources import files as FS
from ..sources.digests import listed_digests
from ..sources.pairs import load_fixture_pairs, project_lang, read_pairs
from . import fixtures as FX
from . import oracle_sql as O
from .prepare import prepare, split_pairs

SEED = 42
SEQ_LEN = 128
BATCH_SIZE = 8
EPOCH = 1
EVAL_SAMPLES = 20
SAMPLE_N = 100
ROUND = 9

_REGISTRY: dict = {}


def query(name: str, sql=None):
    def wrap(fn):
        _REGISTRY[name] = (fn, sql)
        return fn
    return wrap


def registry() -> dict:
    return dict(_REGISTRY)


def _r(c, digits: int = ROUND):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _dealt(df, table):
    """``df`` dealt to all cores if ``table``, where it comes from, is a single
    file: that would be one task for all the text work. Tables of several files
    are read as they come."""
    return spread_rows(df, table.sparkSession.sparkContext.defaultParallelism if len(table.inputFiles()) == 1 else None)


def _documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _dealt(docs.select("doc_id", "text", "lang"), docs)


def _pairs(spark, sf_dir):
    return _dealt(load_fixture_pairs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _conversation_pieces(spark, sf_dir):
    """Partitions for work on the n-grams of the pairs."""
    return pieces(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "text")


def _split(spark, sf_dir, max_samples=None):
    return split_pairs(_pairs(spark, sf_dir), SEED, max_samples)


def _prepared(spark, sf_dir, seq_len=SEQ_LEN, with_decoder_mask=False):
    return prepare(_pairs(spark, sf_dir), SEED, None, seq_len,
                   with_decoder_mask=with_decoder_mask)


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


_VOCAB_SQL = _with(O.split_ctes(SEED), O.vocab_ctes()) + "SELECT lang, token, id FROM vocab"

_REPORT_SQL = _with(O.split_ctes(SEED)) + f"""
SELECT split, count(*) AS rows_before,
       count(*) FILTER (WHERE len(regexp_extract_all(src_text, '{O.PRE_RE2}')) + 2 <= {SEQ_LEN}
                          AND len(regexp_extract_all(tgt_text, '{O.PRE_RE2}')) + 1 <= {SEQ_LEN}) AS rows_after
FROM split GROUP BY split"""

_PREDICTIONS_CTE = _with(O.split_ctes(SEED), O.vocab_ctes(), O.kept_cte(SEQ_LEN), O.encode_ctes()) + """
, test AS (SELECT * FROM encoded WHERE split = 'test'),
dec AS (SELECT id, generate_subscripts(tgt_ids, 1) AS pos, unnest(tgt_ids) AS tid FROM test),
txt AS (SELECT d.id, string_agg(v.token, ' ' ORDER BY d.pos) AS text
        FROM dec d JOIN vocab v ON v.lang = 'it' AND v.id = d.tid WHERE d.tid > 3 GROUP BY d.id),
predictions AS (
  SELECT t.id, t.src_text AS source, t.tgt_text AS reference, coalesce(x.text, '') AS prediction
  FROM test t LEFT JOIN txt x USING (id))
"""


# ---------------------------------------------------------------- 2.1 sources

@query("read_pairs", _with(O.pairs_cte()) + "SELECT id, en, it FROM pairs")
def q_read_pairs(spark, sf_dir):
    """The pair corpus (conversation stand-in), written as Parquet and read by
    ``read_pairs`` with its column check, both languages projected."""
    path = _scratch(spark, "pairs")
    load_fixture_pairs(spark, sf_dir).drop("row_key").write.parquet(path)
    p = read_pairs(spark, path)
    return p.select("id", project_lang(p, "en"), project_lang(p, "it"))


@query("verify_checksum", """
SELECT doc_id AS name, sha256(text) AS sha256,
       CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'mismatch' ELSE 'unpinned' END AS status FROM documents""")
def q_verify_checksum(spark, sf_dir):
    """Digest of every document against pins by rule: the right one for a third
    of the ids, one of an altered text for another third, none for the rest.
    (``verify_files`` checks the files of the tables.)"""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!")))
    pins = docs.where(F.col("doc_id") % 3 != 2).select(F.col("doc_id").alias("name"), F.sha2(text, 256).alias("expected_sha256"))
    return FS.verify_contents(docs, pins, "doc_id", "text")


@query("verify_files")
def q_verify_files(spark, sf_dir):
    """Digests of all table files against pins: those that Spark's whole-file
    reader finds, but a wrong one for ``nation``, none for ``region`` and one
    for a file that is not there."""
    named = listed_digests(spark, sf_dir, "*.parquet")
    table = F.regexp_extract("path", r"(\w+)\.parquet", 1)
    name = F.regexp_extract("path", r"/(\w+\.parquet(/[^/]+)?)$", 1)
    sha = F.when(table == "nation", F.sha2(F.lit(b"other"), 256)).otherwise(F.col("sha256"))
    pins = named.where(table != "region").select(name.alias("name"), sha.alias("expected_sha256"))
    gone = pins.sparkSession.createDataFrame([("gone.parquet", "0" * 64)], pins.schema)
    report = FS.verify_checksum(spark, sf_dir, pins.unionByName(gone), "*.parquet")
    return report.select("name", "length", "sha256", "status")


def _predictions(spark, sf_dir):
    """Prediction table of the test split: hypotheses are the reference's own
    target ids (an oracle model), decoded with the target vocabulary."""
    p = _prepared(spark, sf_dir)
    test = p.encoded.where(F.col("split") == "test")
    return Y.prediction_table(test, test.select("id", "row_key", F.col("tgt_ids").alias("hypothesis")),
                              p.vocab, "it")


@query("write_predictions", _PREDICTIONS_CTE + """
SELECT '  ' || source AS source, reference || chr(9) AS reference,
       CASE WHEN id % 2 = 0 THEN prediction || '  ' ELSE '' END AS prediction FROM predictions""")
def q_write_predictions(spark, sf_dir):
    """Test-split predictions, some with outer white space and some empty,
    written as CSV and read back."""
    path = _scratch(spark, "predictions")
    p = _predictions(spark, sf_dir).select(
        F.concat(F.lit("  "), "source").alias("source"), F.concat("reference", F.lit("\t")).alias("reference"),
        F.when(F.col("id") % 2 == 0, F.concat("prediction", F.lit("  "))).otherwise("").alias("prediction"))
    FS.write_predictions(p, path)
    return FS.read_predictions(spark, path)


@query("append_history", _with(O.history_cte()) + """
SELECT run_id, epoch, round(train_loss, 9) AS train_loss, round(val_loss, 9) AS val_loss, seconds, global_step
FROM history""")
def q_append_history(spark, sf_dir):
    """Epoch rows appended to a history table in overlapping writes, one of them
    repeated, read back: each epoch is there once."""
    path = _scratch(spark, "history")
    hist = H.epoch_summary(FX.batch_losses(spark, sf_dir))
    FS.append_history(hist.where(F.col("epoch") <= 20), path)
    for _ in range(2):
        FS.append_history(hist.where(F.col("epoch") > 10), path, key="second half")
    h = FS.read_history(spark, path, "parquet")
    return h.select("run_id", "epoch", _r("train_loss").alias("train_loss"), _r("val_loss").alias("val_loss"),
                    "seconds", "global_step")


_HISTORY_SELECT = ("SELECT run_id, epoch, round(train_loss, 9) AS train_loss, round(val_loss, 9) AS val_loss, "
                   "seconds, global_step FROM history")


@query("read_history", _with(O.history_cte()) + _HISTORY_SELECT)
def q_read_history(spark, sf_dir):
    """The event-derived history exported as CSV and read back typed."""
    path = _scratch(spark, "history-csv")
    FS.export_history_csv(H.epoch_summary(FX.batch_losses(spark, sf_dir)), path)
    h = FS.read_history(spark, path)
    return h.select("run_id", "epoch", _r("train_loss").alias("train_loss"), _r("val_loss").alias("val_loss"),
                    "seconds", "global_step")


@query("no_overwrite_sink", _VOCAB_SQL)
def q_no_overwrite_sink(spark, sf_dir):
    """A vocabulary stored once; a second write into the used folder is refused."""
    path = _scratch(spark, "run")
    vocab = _prepared(spark, sf_dir).vocab
    V.save_vocab(vocab, path)
    refused = False
    try:
        FS.ensure_new_output(spark, path)
    except FileExistsError:
        refused = True
    if not refused:
        raise AssertionError("a used output folder was not refused")
    return V.load_vocab(spark, path)


# ------------------------------------------------------- 2.2 projection, filter

@query("project_lang", _with(O.pairs_cte()) + "SELECT id, it AS text FROM pairs")
def q_project_lang(spark, sf_dir):
    """One language of every pair."""
    p = _pairs(spark, sf_dir)
    return p.select("id", project_lang(p, "it", "text"))


@query("length_filter", _with(O.split_ctes(SEED), O.kept_cte(SEQ_LEN)) + "SELECT id, split FROM kept")
def q_length_filter(spark, sf_dir):
    """Pairs of every split that fit sequence length 128."""
    return I.length_filter(_split(spark, sf_dir), SEQ_LEN).select("id", "split")


@query("length_filter_report", _REPORT_SQL)
def q_length_filter_report(spark, sf_dir):
    """Rows per split before and after the length filter."""
    return I.length_filter_report(_split(spark, sf_dir), SEQ_LEN)


@query("require_min_rows", _REPORT_SQL)
def q_require_min_rows(spark, sf_dir):
    """The per-split report, after the check that every split keeps a row.
    By contract the query fails when a split is empty after the length
    filter (at sf0.001 with sequence length 128 the test split is)."""
    report = I.length_filter_report(_split(spark, sf_dir), SEQ_LEN)
    I.require_nonempty_splits(report)
    return report


@query("reject_overlong", _with(O.split_ctes(SEED)) + f"""
SELECT id, split, 'overlong' AS reason FROM split
WHERE NOT (len(regexp_extract_all(src_text, '{O.PRE_RE2}')) + 2 <= {SEQ_LEN}
       AND len(regexp_extract_all(tgt_text, '{O.PRE_RE2}')) + 1 <= {SEQ_LEN})""")
def q_reject_overlong(spark, sf_dir):
    """The quarantine: pairs that would not fit, and why."""
    return I.overlong_quarantine(_split(spark, sf_dir), SEQ_LEN).select("id", "split", "reason")


# --------------------------------------------- 2.3 sampling, order, splitting

@query("seeded_shuffle", _with(O.split_ctes(SEED)) + "SELECT id, shuffle_rank FROM split")
def q_seeded_shuffle(spark, sf_dir):
    """Position of every pair in the seed-42 permutation."""
    p = _pairs(spark, sf_dir)
    return S.seeded_shuffle(p, SEED).select("id", "shuffle_rank")


@query("sample_n", _with(O.pairs_cte()) + f"""
SELECT id FROM pairs ORDER BY md5(concat('{SEED}', ':', id)), id LIMIT {SAMPLE_N}""")
def q_sample_n(spark, sf_dir):
    """The first 100 pairs of the seed-42 permutation."""
    return S.sample_n(_pairs(spark, sf_dir), SAMPLE_N, SEED).select("id")


@query("split_train_val_test", _with(O.split_ctes(SEED)) + "SELECT id, split FROM split")
def q_split(spark, sf_dir):
    """train / val / test label of every pair (10 % / 10 %, half-to-even)."""
    return _split(spark, sf_dir).select("id", "split")


_EPOCH_SQL = f"""epoch_rows AS (
  SELECT id, row_number() OVER (ORDER BY md5(concat('{SEED + EPOCH}', ':', id)), id) AS epoch_rank
  FROM split WHERE split = 'train')"""


@query("epoch_shuffle", _with(O.split_ctes(SEED), _EPOCH_SQL) + "SELECT id, epoch_rank FROM epoch_rows")
def q_epoch_shuffle(spark, sf_dir):
    """Order of the training pairs in epoch 1."""
    train = _split(spark, sf_dir).where(F.col("split") == "train")
    return S.epoch_order(train, SEED, EPOCH).select("id", "epoch_rank")


@query("assign_batches", _with(O.split_ctes(SEED), _EPOCH_SQL) + f"""
SELECT id, CAST(floor((epoch_rank - 1) / {BATCH_SIZE}) AS BIGINT) AS batch_id FROM epoch_rows""")
def q_assign_batches(spark, sf_dir):
    """Batch (size 8) of every training pair in epoch 1."""
    return S.epoch_batches(_split(spark, sf_dir), SEED, EPOCH, BATCH_SIZE).select("id", "batch_id")


@query("split_batches", _with(O.split_ctes(SEED)) + f"""
SELECT id, CAST(floor((row_number() OVER (ORDER BY shuffle_rank) - 1) / {BATCH_SIZE}) AS BIGINT) AS batch_id
FROM split WHERE split = 'val'""")
def q_split_batches(spark, sf_dir):
    """Batch (size 8) of every validation pair, in split order."""
    return S.split_batches(_split(spark, sf_dir), "val", BATCH_SIZE).select("id", "batch_id")


@query("eval_limit", _with(O.split_ctes(SEED), O.kept_cte(SEQ_LEN)) + f"""
SELECT id FROM kept WHERE split = 'test' ORDER BY shuffle_rank LIMIT {EVAL_SAMPLES}""")
def q_eval_limit(spark, sf_dir):
    """The first 20 test pairs that fit sequence length 128, in split order."""
    return S.eval_limit(I.length_filter(_split(spark, sf_dir), SEQ_LEN), EVAL_SAMPLES).select("id")


# ------------------------------------------------- 2.4 text, vocabulary, encode

@query("pre_tokenize", f"""
SELECT doc_id, regexp_extract_all(text, '{O.PRE_RE2}') AS tokens FROM documents""")
def q_pre_tokenize(spark, sf_dir):
    """Word/punctuation tokens of every whole document."""
    d = _documents(spark, sf_dir)
    return d.select("doc_id", pre_tokenize("text").alias("tokens"))


@query("word_counts", f"""
SELECT lang, token, count(*) AS count
FROM (SELECT lang, unnest(regexp_extract_all(text, '{O.PRE_RE2}')) AS token FROM documents)
GROUP BY lang, token""")
def q_word_counts(spark, sf_dir):
    """Token frequencies per document language over all documents."""
    d = _documents(spark, sf_dir)
    return V.word_counts_by_column(d, "text", "lang")


@query("build_vocab", _VOCAB_SQL)
def q_build_vocab(spark, sf_dir):
    """Source and target vocabularies trained on the training split."""
    return V.train_vocab(_split(spark, sf_dir), {"en": "src_text", "it": "tgt_text"})


@query("build_vocab_documents", f"""
WITH c AS (
  SELECT unnest(regexp_extract_all(text, '{O.PRE_RE2}')) AS token FROM documents),
counts AS (SELECT token, count(*) AS count FROM c GROUP BY token)
SELECT 'doc' AS lang, token, CAST(row_number() OVER (ORDER BY count DESC, token) + 3 AS INTEGER) AS id
FROM counts WHERE count >= 2 QUALIFY id < 30000
UNION ALL
SELECT 'doc', token, CAST(id AS INTEGER) FROM (VALUES ('[UNK]', 0), ('[PAD]', 1), ('[SOS]', 2), ('[EOS]', 3)) s(token, id)""")
def q_build_vocab_documents(spark, sf_dir):
    """The capped vocabulary on a corpus with more candidates than the cap."""
    d = _documents(spark, sf_dir)
    return V.build_vocab(V.word_counts(d, {"doc": "text"}), ["doc"])


@query("save_load_vocab", _VOCAB_SQL)
def q_save_load_vocab(spark, sf_dir):
    """A trained vocabulary stored, then reused unchanged."""
    path = _scratch(spark, "vocab")
    split = _split(spark, sf_dir)
    first = V.load_or_train_vocab(spark, path, split, {"en": "src_text", "it": "tgt_text"})
    again = V.load_or_train_vocab(spark, path, split, {"en": "src_text", "it": "tgt_text"})
    if first.exceptAll(again).count() or again.exceptAll(first).count():
        raise AssertionError("stored vocabulary was not reused as is")
    return again


@query("vocab_size", _with(O.split_ctes(SEED), O.vocab_ctes()) +
       "SELECT lang, count(*) AS vocab_size FROM vocab GROUP BY lang")
def q_vocab_size(spark, sf_dir):
    """Vocabulary size per language."""
    return V.vocab_size(V.train_vocab(_split(spark, sf_dir), {"en": "src_text", "it": "tgt_text"}))


@query("token_to_id", _with(O.split_ctes(SEED), O.vocab_ctes()) + f"""
SELECT t.doc_id, t.pos, t.token, coalesce(v.id, 0) AS token_id
FROM (SELECT doc_id, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token
      FROM (SELECT doc_id, regexp_extract_all(text, '{O.PRE_RE2}') AS toks FROM documents)) t
LEFT JOIN vocab v ON v.lang = 'en' AND v.token = t.token""")
def q_token_to_id(spark, sf_dir):
    """Every token of every document looked up in the source vocabulary."""
    vocab = V.train_vocab(_split(spark, sf_dir), {"en": "src_text", "it": "tgt_text"})
    d = _documents(spark, sf_dir)
    toks = d.select("doc_id", F.posexplode(pre_tokenize("text")).alias("pos", "token"))
    return V.token_to_id(toks, "token", vocab, "en").select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "token", "token_id")


@query("id_to_token", _with(O.split_ctes(SEED), O.vocab_ctes(), O.kept_cte(SEQ_LEN), O.encode_ctes()) + """
, ids AS (SELECT id, generate_subscripts(tgt_ids, 1) - 1 AS pos, unnest(tgt_ids) AS token_id FROM encoded)
SELECT i.id, i.pos, i.token_id, v.token FROM ids i LEFT JOIN vocab v ON v.lang = 'it' AND v.id = i.token_id""")
def q_id_to_token(spark, sf_dir):
    """Every target id of the encoded pairs, looked up in long form."""
    p = _prepared(spark, sf_dir)
    ids = p.encoded.select("id", F.posexplode("tgt_ids").alias("pos", "token_id"))
    return V.id_to_token(ids, "token_id", p.vocab, "it").select(
        "id", F.col("pos").cast("bigint").alias("pos"), "token_id", "token")


@query("encode", _with(O.split_ctes(SEED), O.vocab_ctes(), O.kept_cte(SEQ_LEN), O.encode_ctes()) +
       "SELECT id, src_ids, tgt_ids FROM encoded")
def q_encode(spark, sf_dir):
    """Source and target ids of the pairs that fit."""
    return _prepared(spark, sf_dir).encoded.select("id", "src_ids", "tgt_ids")


@query("encode_documents", _with(O.split_ctes(SEED), O.vocab_ctes()) + f"""
, tok AS (
  SELECT doc_id, generate_subscripts(toks, 1) AS pos, unnest(toks) AS token
  FROM (SELECT doc_id, regexp_extract_all(text, '{O.PRE_RE2}') AS toks FROM documents)),
enc AS (
  SELECT t.doc_id, list(coalesce(v.id, 0) ORDER BY t.pos) AS ids
  FROM tok t LEFT JOIN vocab v ON v.lang = 'en' AND v.token = t.token GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(e.ids, []::INTEGER[]) AS ids FROM documents d LEFT JOIN enc e USING (doc_id)""")
def q_encode_documents(spark, sf_dir):
    """Whole documents (up to 20,000 words) through the source vocabulary."""
    vocab = V.train_vocab(_split(spark, sf_dir), {"en": "src_text", "it": "tgt_text"})
    d = _documents(spark, sf_dir)
    return E.encode_ids(d, ["doc_id"], {"ids": ("text", "en")}, vocab)


@query("oov_rate", _with(O.split_ctes(SEED), O.vocab_ctes(), O.kept_cte(SEQ_LEN), O.encode_ctes()) + """
SELECT split,
       CAST(sum(len(list_filter(src_ids, lambda x: x = 0))) AS BIGINT) AS src_ids_unk,
       CAST(sum(len(src_ids)) AS BIGINT) AS src_ids_tokens,
       round(sum(len(list_filter(src_ids, lambda x: x = 0))) / sum(len(src_ids)), 9) AS src_ids_oov_rate,
       CAST(sum(len(list_filter(tgt_ids, lambda x: x = 0))) AS BIGINT) AS tgt_ids_unk,
       CAST(sum(len(tgt_ids)) AS BIGINT) AS tgt_ids_tokens,
       round(sum(len(list_filter(tgt_ids, lambda x: x = 0))) / sum(len(tgt_ids)), 9) AS tgt_ids_oov_rate
FROM encoded GROUP BY split""")
def q_oov_rate(spark, sf_dir):
    """Share of unknown ids per split and side."""
    r = E.oov_rate(_prepared(spark, sf_dir).encoded, ["split"], ["src_ids", "tgt_ids"])
    return r.select("split", "src_ids_unk", "src_ids_tokens", _r("src_ids_oov_rate").alias("src_ids_oov_rate"),
                    "tgt_ids_unk", "tgt_ids_tokens", _r("tgt_ids_oov_rate").alias("tgt_ids_oov_rate"))


@query("decode", _with(O.split_ctes(SEED), O.vocab_ctes(), O.kept_cte(SEQ_LEN), O.encode_ctes()) + """
, dec AS (
  SELECT e.id, generate_subscripts(e.tgt_ids, 1) AS pos, unnest(e.tgt_ids) AS tid FROM encoded e),
joined AS (
  SELECT d.id, string_agg(v.token, ' ' ORDER BY d.pos) AS text
  FROM dec d JOIN vocab v ON v.lang = 'it' AND v.id = d.tid
  WHERE d.tid > 3 GROUP BY d.id)
SELECT e.id, coalesce(j.text, '') AS text FROM encoded e LEFT JOIN joined j USING (id)""")
def q_decode(spark, sf_dir):
    """Target ids decoded back to text (specials dropped)."""
    p = _prepared(spark, sf_dir)
    return E.decode_texts(p.encoded, ["id"], "tgt_ids", p.vocab, "it", "text")


# ------------------------------------------------------ 2.5 array construction

def _inputs_sql(select: str, seq_len: int = SEQ_LEN) -> str:
    return _with(O.split_ctes(SEED), O.vocab_ctes(), O.kept_cte(seq_len), O.encode_ctes()) + select


@query("encoder_input", _inputs_sql(f"SELECT id, {O.encoder_input('src_ids', SEQ_LEN)} AS encoder_input FROM encoded"))
def q_encoder_input(spark, sf_dir):
    """Encoder inputs (length 128)."""
    e = _prepared(spark, sf_dir).encoded
    return e.select("id", A.encoder_input("src_ids", SEQ_LEN).alias("encoder_input"))


@query("decoder_input", _inputs_sql(f"SELECT id, {O.decoder_input('tgt_ids', SEQ_LEN)} AS decoder_input FROM encoded"))
def q_decoder_input(spark, sf_dir):
    """Decoder inputs (length 128)."""
    e = _prepared(spark, sf_dir).encoded
    return e.select("id", A.decoder_input("tgt_ids", SEQ_LEN).alias("decoder_input"))


@query("label", _inputs_sql(f"SELECT id, {O.label('tgt_ids', SEQ_LEN)} AS label FROM encoded"))
def q_label(spark, sf_dir):
    """Labels (length 128)."""
    e = _prepared(spark, sf_dir).encoded
    return e.select("id", A.label("tgt_ids", SEQ_LEN).alias("label"))


@query("assert_lengths", _inputs_sql(f"""
SELECT CAST(count(*) FILTER (WHERE len({O.encoder_input('src_ids', SEQ_LEN)}) <> {SEQ_LEN}
                           OR len({O.decoder_input('tgt_ids', SEQ_LEN)}) <> {SEQ_LEN}
                           OR len({O.label('tgt_ids', SEQ_LEN)}) <> {SEQ_LEN}) AS BIGINT) AS bad_rows,
       count(*) AS rows FROM encoded"""))
def q_assert_lengths(spark, sf_dir):
    """Rows whose arrays are not 128 long (none)."""
    return I.assert_lengths(_prepared(spark, sf_dir).inputs, SEQ_LEN)


@query("encoder_mask", _inputs_sql(
    f"SELECT id, {O.encoder_mask(O.encoder_input('src_ids', SEQ_LEN))} AS encoder_mask FROM encoded"))
def q_encoder_mask(spark, sf_dir):
    """Encoder padding masks."""
    e = _prepared(spark, sf_dir).encoded
    return e.select("id", A.encoder_mask(A.encoder_input("src_ids", SEQ_LEN)).alias("encoder_mask"))


@query("decoder_mask", _inputs_sql(
    f"SELECT id, {O.decoder_mask(O.decoder_input('tgt_ids', SEQ_LEN), SEQ_LEN)} AS decoder_mask FROM encoded",
    SEQ_LEN))
def q_decoder_mask(spark, sf_dir):
    """Decoder masks (128 × 128: padding and causal)."""
    e = _prepared(spark, sf_dir, SEQ_LEN).encoded
    return e.select("id", A.decoder_mask(A.decoder_input("tgt_ids", SEQ_LEN), SEQ_LEN).alias("decoder_mask"))


@query("model_inputs", _inputs_sql(f"""
SELECT id, split, {O.encoder_input('src_ids', SEQ_LEN)} AS encoder_input,
       {O.decoder_input('tgt_ids', SEQ_LEN)} AS decoder_input,
       {O.label('tgt_ids', SEQ_LEN)} AS label,
       {O.encoder_mask(O.encoder_input('src_ids', SEQ_LEN))} AS encoder_mask,
       {O.decoder_mask(O.decoder_input('tgt_ids', SEQ_LEN), SEQ_LEN)} AS decoder_mask,
       src_text, tgt_text
FROM encoded""", SEQ_LEN))
def q_model_inputs(spark, sf_dir):
    """The full model-input rows at sequence length 128."""
    return _prepared(spark, sf_dir, SEQ_LEN, with_decoder_mask=True).inputs.drop("row_key")


@query("prompt_input", _with(O.split_ctes(SEED), O.vocab_ctes()) + f"""
, src AS (SELECT u.conv_id * 1000000000 + u.turn AS id, u.text FROM conversations u WHERE u.role = 'user'),
fit AS (SELECT *, CASE WHEN len(regexp_extract_all(text, '{O.PRE_RE2}')) + 2 <= {SEQ_LEN} THEN 'ok' ELSE 'too_long' END
               AS status FROM src),
tok AS (SELECT id, generate_subscripts(t, 1) AS pos, unnest(t) AS token
        FROM (SELECT id, regexp_extract_all(text, '{O.PRE_RE2}') AS t FROM fit)),
enc AS (SELECT t.id, list(coalesce(v.id, 0) ORDER BY t.pos) AS ids FROM tok t
        LEFT JOIN vocab v ON v.lang = 'en' AND v.token = t.token GROUP BY t.id),
e2 AS (SELECT f.id, f.text, f.status, coalesce(e.ids, []::INTEGER[]) AS ids FROM fit f LEFT JOIN enc e USING (id))
SELECT id, text, status, CASE WHEN status = 'ok' THEN {O.encoder_input('ids', SEQ_LEN)} END AS encoder_input,
       CASE WHEN status = 'ok' THEN {O.encoder_mask(O.encoder_input('ids', SEQ_LEN))} END AS encoder_mask FROM e2""")
def q_prompt_input(spark, sf_dir):
    """Inference inputs for every user turn; one that does not fit has a
    status and no inputs."""
    vocab = V.train_vocab(_split(spark, sf_dir), {"en": "src_text", "it": "tgt_text"})
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where(F.col("role") == "user")
    texts = c.select((F.col("conv_id") * 1000000000 + F.col("turn")).alias("id"), "text")
    return I.prompt_input(texts, ["id"], "text", vocab, "en", SEQ_LEN, on_long="report")


# ------------------------------------------------------------- 2.6 losses

_LOSS_ROW = """list_transform(embedding, lambda x: CAST(x AS DOUBLE))"""


def _loss_sql(eps: float) -> str:
    return f"""
WITH z AS (SELECT vec_id, label, {_LOSS_ROW} AS z FROM embeddings),
m AS (SELECT *, list_max(z) AS m FROM z),
l AS (SELECT *, m + ln(list_sum(list_transform(z, lambda x: exp(x - m)))) AS lse FROM m)
SELECT round(avg(CASE WHEN label <> 1 THEN (1 - {eps}) * (lse - z[label + 1])
                                     + {eps} * (lse - list_sum(z) / len(z)) END), 9) AS loss,
       count(*) FILTER (WHERE label <> 1) AS tokens
FROM l"""


@query("smoothed_cross_entropy", _loss_sql(0.1))
def q_smoothed_ce(spark, sf_dir):
    """Mean label-smoothed (0.1) cross entropy of the logits table, PAD labels ignored."""
    r = L.cross_entropy(FX.logits(spark, sf_dir), "logits", "label", 0.1)
    return r.select(_r("loss").alias("loss"), "tokens")


@query("cross_entropy_of_scores", _loss_sql(0.1))
def q_cross_entropy_of_scores(spark, sf_dir):
    """The same loss from scores in long form, a row per position and token."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    labels = e.select(F.floor(F.col("vec_id") / FX.STEPS_PER_PAIR).alias("pair_id"),
                      (F.col("vec_id") % FX.STEPS_PER_PAIR).alias("step"), "label")
    r = L.cross_entropy_of_scores(FX.long_scores(spark, sf_dir), labels)
    return r.select(_r("loss").alias("loss"), "tokens")


@query("cross_entropy", _loss_sql(0.0))
def q_ce(spark, sf_dir):
    """Mean plain cross entropy of the logits table, PAD labels ignored."""
    r = L.cross_entropy(FX.logits(spark, sf_dir), "logits", "label", 0.0)
    return r.select(_r("loss").alias("loss"), "tokens")


@query("token_losses", """
WITH z AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings),
m AS (SELECT *, list_max(z) AS m FROM z),
l AS (SELECT *, m + ln(list_sum(list_transform(z, lambda x: exp(x - m)))) AS lse FROM m)
SELECT vec_id, round(0.9 * (lse - z[label + 1]) + 0.1 * (lse - list_sum(z) / len(z)), 9) AS loss FROM l""")
def q_token_losses(spark, sf_dir):
    """Label-smoothed loss of every logits row."""
    lg = FX.logits(spark, sf_dir)
    return lg.select("vec_id", _r(L.token_loss("logits", "label", 0.1)).alias("loss"))


@query("label_tokens", _inputs_sql(f"""
, rows_ AS (SELECT id, {O.label('tgt_ids', SEQ_LEN)} AS label FROM encoded)
SELECT id, len(list_filter(label, lambda x: x <> 1)) AS tokens FROM rows_"""))
def q_label_tokens(spark, sf_dir):
    """Non-PAD label tokens of every encoded pair."""
    e = _prepared(spark, sf_dir).encoded
    return e.select("id", L.label_tokens(A.label("tgt_ids", SEQ_LEN)).cast("bigint").alias("tokens"))


@query("epoch_loss", _with(O.batches_cte()) + """
SELECT run_id, epoch, phase, round(sum(loss * tokens) / sum(tokens), 9) AS epoch_loss,
       count(*) AS batches, CAST(sum(tokens) AS BIGINT) AS tokens
FROM batches GROUP BY run_id, epoch, phase""")
def q_epoch_loss(spark, sf_dir):
    """Token-weighted loss per run, epoch and phase."""
    r = L.epoch_loss(FX.batch_losses(spark, sf_dir))
    return r.select("run_id", "epoch", "phase", _r("epoch_loss").alias("epoch_loss"), "batches", "tokens")


@query("batch_loss", """
WITH z AS (SELECT floor(vec_id / 8) AS batch_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings),
m AS (SELECT *, list_max(z) AS m FROM z),
l AS (SELECT *, m + ln(list_sum(list_transform(z, lambda x: exp(x - m)))) AS lse FROM m)
SELECT CAST(batch_id AS BIGINT) AS batch_id,
       round(avg(CASE WHEN label <> 1 THEN 0.9 * (lse - z[label + 1]) + 0.1 * (lse - list_sum(z) / len(z)) END), 9) AS loss,
       count(*) FILTER (WHERE label <> 1) AS tokens
FROM l GROUP BY batch_id""")
def q_batch_loss(spark, sf_dir):
    """Loss and tokens of every batch of eight logits rows."""
    lg = FX.logits(spark, sf_dir).withColumn("batch_id", F.floor(F.col("vec_id") / BATCH_SIZE))
    return L.batch_loss(lg, "logits", "label").select("batch_id", _r("loss").alias("loss"), "tokens")


@query("running_loss", _with(O.batches_cte()) + """
SELECT run_id, epoch, phase, batch_id,
       round(sum(loss * tokens) OVER w / sum(tokens) OVER w, 9) AS running_loss,
       CAST(sum(tokens) OVER w AS BIGINT) AS cum_tokens
FROM batches
WINDOW w AS (PARTITION BY run_id, epoch, phase ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_running_loss(spark, sf_dir):
    """Token-weighted loss after every batch."""
    r = L.running_loss(FX.batch_losses(spark, sf_dir))
    return r.select("run_id", "epoch", "phase", "batch_id", _r("running_loss").alias("running_loss"),
                    F.col("cum_tokens").cast("bigint").alias("cum_tokens"))


# ------------------------------------------------------------ 2.7 history

def _history(spark, sf_dir):
    return H.epoch_summary(FX.batch_losses(spark, sf_dir))


@query("epoch_summary", _with(O.history_cte()) + """
SELECT run_id, epoch, round(train_loss, 9) AS train_loss, round(val_loss, 9) AS val_loss, seconds, global_step
FROM history""")
def q_epoch_summary(spark, sf_dir):
    """History rows derived from the batch losses."""
    h = _history(spark, sf_dir)
    return h.select("run_id", "epoch", _r("train_loss").alias("train_loss"), _r("val_loss").alias("val_loss"),
                    "seconds", "global_step")


@query("global_step", _with(O.history_cte()) + "SELECT run_id, epoch, global_step FROM history")
def q_global_step(spark, sf_dir):
    """Cumulative training batches per epoch."""
    per_epoch = FX.batch_losses(spark, sf_dir).groupBy("run_id", "epoch").agg(
        F.count_if(F.col("phase") == "train").alias("train_batches"))
    return H.global_step(per_epoch).select("run_id", "epoch", "global_step")


_PROGRESS_SQL = _with(O.history_cte()) + """
SELECT run_id, epoch, round(min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS best_so_far,
       coalesce(val_loss < coalesce(min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'infinity'::DOUBLE), false) AS improved
FROM history"""


@query("best_so_far", _PROGRESS_SQL)
def q_best_so_far(spark, sf_dir):
    """Running best validation loss and the improvement flag."""
    p = H.with_progress(_history(spark, sf_dir))
    return p.select("run_id", "epoch", _r("best_so_far").alias("best_so_far"), "improved")


@query("improved", _with(O.history_cte()) + """
SELECT run_id, epoch FROM history
QUALIFY val_loss < coalesce(min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'infinity'::DOUBLE)""")
def q_improved(spark, sf_dir):
    """Epochs that improved on every earlier epoch."""
    p = H.with_progress(_history(spark, sf_dir))
    return p.where("improved").select("run_id", "epoch")


@query("best_epoch", _with(O.history_cte()) + """
SELECT run_id, arg_min(epoch, (val_loss, epoch)) FILTER (WHERE val_loss IS NOT NULL) AS best_epoch, round(min(val_loss), 9) AS best_val_loss
FROM history GROUP BY run_id""")
def q_best_epoch(spark, sf_dir):
    """Epoch of the lowest validation loss (first on ties)."""
    b = H.best_epoch(_history(spark, sf_dir))
    return b.select("run_id", "best_epoch", _r("best_val_loss").alias("best_val_loss"))


@query("learning_curve", _with(O.history_cte()) + """
, best AS (SELECT run_id, arg_min(epoch, (val_loss, epoch)) FILTER (WHERE val_loss IS NOT NULL) AS best_epoch FROM history GROUP BY run_id),
long AS (
  SELECT run_id, epoch, 'train' AS series, train_loss AS loss FROM history
  UNION ALL SELECT run_id, epoch, 'val', val_loss FROM history)
SELECT l.run_id, l.epoch, l.series, round(l.loss, 9) AS loss,
       coalesce(l.series = 'val' AND l.epoch = b.best_epoch, false) AS is_best
FROM long l JOIN best b USING (run_id)""")
def q_learning_curve(spark, sf_dir):
    """Long-form learning curve with the best point marked."""
    c = H.learning_curve(_history(spark, sf_dir))
    return c.select("run_id", "epoch", "series", _r("loss").alias("loss"), "is_best")


@query("resume_point", _with(O.history_cte()) + """
SELECT run_id, max(epoch) + 1 AS next_epoch, arg_max(global_step, epoch) AS global_step,
       round(min(val_loss), 9) AS best_val_loss
FROM history GROUP BY run_id""")
def q_resume_point(spark, sf_dir):
    """Where each run would resume."""
    r = H.resume_point(_history(spark, sf_dir))
    return r.select("run_id", "next_epoch", "global_step", _r("best_val_loss").alias("best_val_loss"))


# ------------------------------------------------ 2.8 hypotheses, scoring

@query("greedy_pick", """
WITH s AS (
  SELECT floor(vec_id / 16) AS pair_id, vec_id - floor(vec_id / 16) * 16 AS step,
         generate_subscripts(embedding, 1) - 1 AS token_id, unnest(embedding) AS score
  FROM embeddings)
SELECT CAST(pair_id AS BIGINT) AS pair_id, CAST(step AS BIGINT) AS step,
       CAST(arg_max(token_id, (score, -token_id)) AS INTEGER) AS token_id
FROM s GROUP BY pair_id, step""")
def q_greedy_pick(spark, sf_dir):
    """Top token of every decoding step (ties to the lowest id)."""
    g = Y.greedy_pick(FX.long_scores(spark, sf_dir))
    return g.select(F.col("pair_id").cast("bigint"), F.col("step").cast("bigint"),
                    F.col("token_id").cast("int"))


@query("argmax_dense", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS token_id FROM embeddings""")
def q_argmax_dense(spark, sf_dir):
    """Index of the first maximum of every logits row."""
    return FX.logits(spark, sf_dir).select("vec_id", Y.argmax_dense("logits").alias("token_id"))


@query("truncate_hypothesis", f"""
WITH s AS (
  SELECT floor(vec_id / 16) AS pair_id, vec_id - floor(vec_id / 16) * 16 AS step,
         generate_subscripts(embedding, 1) - 1 AS token_id, unnest(embedding) AS score
  FROM embeddings),
p AS (SELECT pair_id, step, arg_max(token_id, (score, -token_id)) AS token_id FROM s GROUP BY pair_id, step),
seqs AS (SELECT pair_id, list(CAST(token_id AS INTEGER) ORDER BY step) AS picks
         FROM p WHERE step < {SEQ_LEN} - 1 GROUP BY pair_id)
SELECT CAST(pair_id AS BIGINT) AS pair_id,
       ([2] || picks)[1:CASE WHEN list_position(picks, 3) > 0
                             THEN least(list_position(picks, 3) + 1, {SEQ_LEN})
                             ELSE least(len(picks) + 1, {SEQ_LEN}) END] AS hypothesis
FROM seqs""")
def q_truncate_hypothesis(spark, sf_dir):
    """Hypotheses assembled per pair and cut after the first EOS."""
    picks = Y.greedy_pick(FX.long_scores(spark, sf_dir))
    h = Y.assemble_hypotheses(picks, SEQ_LEN)
    return h.select(F.col("pair_id").cast("bigint"), "hypothesis")


def _echo_hypothesis_sql(ei: str) -> str:
    picks = f"{ei}[2:]"
    return (f"([2] || {picks})[1:CASE WHEN list_position({picks}, 3) > 0 "
            f"THEN least(list_position({picks}, 3) + 1, {SEQ_LEN}) ELSE least(len({picks}) + 1, {SEQ_LEN}) END]")


@query("score_corpus", _inputs_sql(f"""
, inp AS (SELECT id, {O.encoder_input('src_ids', SEQ_LEN)} AS ei FROM encoded)
SELECT id, {_echo_hypothesis_sql('ei')} AS hypothesis FROM inp"""))
def q_score_corpus(spark, sf_dir):
    """Batch scoring of every encoder input with a deterministic stand-in
    model (it echoes its input), then the usual truncation at ``[EOS]``."""
    from ..plans.evaluate import echo_model

    inputs = _prepared(spark, sf_dir).inputs
    scored = Y.score_corpus(inputs, echo_model, "encoder_input", "hypothesis", seq_len=SEQ_LEN)
    return scored.select("id", Y.truncate_hypothesis(F.slice("hypothesis", 2, SEQ_LEN), SEQ_LEN).alias("hypothesis"))


@query("prediction_table", _PREDICTIONS_CTE + "SELECT id, source, reference, prediction FROM predictions")
def q_prediction_table(spark, sf_dir):
    """Source, reference and decoded prediction of the test pairs."""
    return _predictions(spark, sf_dir)


# ----------------------------------------------------------- 2.9 metrics

_METRIC_PAIRS = _with(O.pairs_cte()) + f"""
, w AS (SELECT id, en AS hyp, it AS ref, {O.words('en')} AS hw, {O.words('it')} AS rw FROM pairs)
"""


@query("ngram_counts", _with(O.pairs_cte()) + f"""
, w AS (SELECT id, {O.words('it')} AS w FROM pairs),
g AS (
  {' UNION ALL '.join(f"SELECT id, {n} AS n, unnest({O.ngram_list('w', n)}) AS gram FROM w" for n in range(1, 5))})
SELECT id, n, gram, count(*) AS count FROM g GROUP BY id, n, gram""")
def q_ngram_counts(spark, sf_dir):
    """Word 1- to 4-gram counts of every reference text."""
    p = load_fixture_pairs(spark, sf_dir)
    return X.ngram_counts(p.select("id", project_lang(p, "it", "text")), ["id"], "text",
                          partitions=_conversation_pieces(spark, sf_dir)).select("id", "n", "gram", "count")


def _bleu_sql() -> str:
    grams = " UNION ALL ".join(
        f"SELECT id, {n} AS n, 0 AS side, unnest({O.ngram_list('hw', n)}) AS gram FROM w UNION ALL "
        f"SELECT id, {n} AS n, 1 AS side, unnest({O.ngram_list('rw', n)}) AS gram FROM w" for n in range(1, 5))
    return _METRIC_PAIRS + f""", g AS ({grams}),
c AS (SELECT id, n, gram, count(*) FILTER (WHERE side = 0) AS h, count(*) FILTER (WHERE side = 1) AS r
      FROM g GROUP BY id, n, gram),
s AS (SELECT n, sum(least(h, r)) AS clipped, sum(h) AS total FROM c GROUP BY n),
lens AS (SELECT sum(len(hw)) AS hyp_len, sum(len(rw)) AS ref_len FROM w),
agg AS (
  SELECT coalesce(max(clipped) FILTER (WHERE n = 1), 0) AS c1, coalesce(max(total) FILTER (WHERE n = 1), 0) AS t1,
         coalesce(max(clipped) FILTER (WHERE n = 2), 0) AS c2, coalesce(max(total) FILTER (WHERE n = 2), 0) AS t2,
         coalesce(max(clipped) FILTER (WHERE n = 3), 0) AS c3, coalesce(max(total) FILTER (WHERE n = 3), 0) AS t3,
         coalesce(max(clipped) FILTER (WHERE n = 4), 0) AS c4, coalesce(max(total) FILTER (WHERE n = 4), 0) AS t4
  FROM s)
SELECT round(CASE WHEN least(c1, c2, c3, c4) = 0 THEN 0.0
             ELSE (CASE WHEN hyp_len > ref_len THEN 1.0 ELSE exp(1 - ref_len / hyp_len) END)
                  * exp(ln(c1 / t1) / 4 + ln(c2 / t2) / 4 + ln(c3 / t3) / 4 + ln(c4 / t4) / 4) END, 9) AS bleu,
       round(c1 / t1, 9) AS precision_1, round(c2 / t2, 9) AS precision_2,
       round(c3 / t3, 9) AS precision_3, round(c4 / t4, 9) AS precision_4,
       CAST(hyp_len AS BIGINT) AS hyp_len, CAST(ref_len AS BIGINT) AS ref_len
FROM agg, lens"""


def _metric_pairs(spark, sf_dir, dealt=True):
    p = _pairs(spark, sf_dir) if dealt else load_fixture_pairs(spark, sf_dir)
    return p.select("id", project_lang(p, "en", "hyp"), project_lang(p, "it", "ref"))


@query("bleu", _bleu_sql())
def q_bleu(spark, sf_dir):
    """Corpus BLEU-4 of user turns against the assistant turns."""
    b = X.bleu(_metric_pairs(spark, sf_dir, dealt=False), ["id"], "hyp", "ref",
               partitions=_conversation_pieces(spark, sf_dir))
    return b.select(_r("bleu").alias("bleu"), *[_r(f"precision_{n}").alias(f"precision_{n}") for n in range(1, 5)],
                    "hyp_len", "ref_len")


@query("cer", _METRIC_PAIRS + f"""
SELECT round(sum({O.char_edit_sql('hyp', 'ref')}) / sum(length(ref)), 9) AS cer FROM w""")
def q_cer(spark, sf_dir):
    """Corpus character error rate of the same pairs."""
    return X.cer(_metric_pairs(spark, sf_dir), "hyp", "ref").select(_r("cer").alias("cer"))


@query("wer", _METRIC_PAIRS + f"""
SELECT round(sum({O.word_edit_sql('hw', 'rw')}) / sum(len(rw)), 9) AS wer FROM w""")
def q_wer(spark, sf_dir):
    """Corpus word error rate of the same pairs."""
    return X.wer(_metric_pairs(spark, sf_dir), "hyp", "ref").select(_r("wer").alias("wer"))


@query("sentence_errors", _METRIC_PAIRS + f"""
SELECT id, {O.char_edit_sql('hyp', 'ref')} AS char_errors, length(ref) AS ref_chars,
       {O.word_edit_sql('hw', 'rw')} AS word_errors, len(rw) AS ref_words FROM w""")
def q_sentence_errors(spark, sf_dir):
    """Per-pair edit counts and reference lengths."""
    e = X.sentence_errors(_metric_pairs(spark, sf_dir), ["id"], "hyp", "ref")
    return e.select("id", F.col("char_errors").cast("bigint"), F.col("ref_chars").cast("bigint"),
                    F.col("word_errors").cast("bigint"), F.col("ref_words").cast("bigint"))


def _test_results_sql() -> str:
    bleu_body = _bleu_sql().split("SELECT round(CASE", 1)
    return (bleu_body[0].rstrip() + f""",
bleu_row AS (
  SELECT CASE WHEN least(c1, c2, c3, c4) = 0 THEN 0.0
              ELSE (CASE WHEN hyp_len > ref_len THEN 1.0 ELSE exp(1 - ref_len / hyp_len) END)
                   * exp(ln(c1 / t1) / 4 + ln(c2 / t2) / 4 + ln(c3 / t3) / 4 + ln(c4 / t4) / 4) END AS bleu
  FROM agg, lens),
err AS (
  SELECT sum({O.char_edit_sql('hyp', 'ref')}) / sum(length(ref)) AS cer,
         sum({O.word_edit_sql('hw', 'rw')}) / sum(len(rw)) AS wer, count(*) AS decoded_test_examples
  FROM w),
z AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings),
m AS (SELECT *, list_max(z) AS m FROM z),
l AS (SELECT *, m + ln(list_sum(list_transform(z, lambda x: exp(x - m)))) AS lse FROM m),
loss AS (SELECT avg(CASE WHEN label <> 1 THEN 0.9 * (lse - z[label + 1]) + 0.1 * (lse - list_sum(z) / len(z)) END)
                AS test_loss FROM l),
{O.history_cte()},
best AS (SELECT arg_min(epoch, (val_loss, epoch)) FILTER (WHERE val_loss IS NOT NULL) AS best_epoch FROM history WHERE run_id = 'run1')
SELECT round(test_loss, 9) AS test_loss, round(bleu, 9) AS bleu, round(cer, 9) AS cer, round(wer, 9) AS wer,
       CAST(decoded_test_examples AS BIGINT) AS decoded_test_examples,
       CAST(decoded_test_examples AS BIGINT) AS all_test_examples,
       'best.pt' AS checkpoint, CAST(best_epoch AS INTEGER) AS best_epoch
FROM loss, bleu_row, err, best""")


@query("test_results", _test_results_sql())
def q_test_results(spark, sf_dir):
    """The results row over the stand-ins: loss of the logits table, metrics
    and counts of the conversation pairs, best epoch of one run of the event
    history. (``evaluate_run`` is the same over a real test split.)"""
    pairs = _metric_pairs(spark, sf_dir, dealt=False)
    loss = L.cross_entropy(FX.logits(spark, sf_dir), "logits", "label", 0.1)
    scores = X.corpus_scores(pairs, ["id"], "hyp", "ref", partitions=_conversation_pieces(spark, sf_dir))
    best = H.best_epoch(_history(spark, sf_dir))
    r = X.test_results(loss, scores, pairs, best, "run1")
    return r.select(*[_r(c).alias(c) for c in ("test_loss", "bleu", "cer", "wer")],
                    "decoded_test_examples", "all_test_examples", "checkpoint", "best_epoch")


# ---------------------------------------------------------- 2.10 manifest

@query("data_manifest", _with(O.split_ctes(SEED), O.vocab_ctes(), O.kept_cte(SEQ_LEN)) + """
SELECT (SELECT count(*) FROM pairs) AS original_examples,
       (SELECT max(selected) FROM split) AS selected_examples,
       (SELECT count(*) FILTER (WHERE split = 'train') FROM split) AS train_before,
       (SELECT count(*) FILTER (WHERE split = 'val') FROM split) AS val_before,
       (SELECT count(*) FILTER (WHERE split = 'test') FROM split) AS test_before,
       (SELECT count(*) FILTER (WHERE split = 'train') FROM kept) AS train_after,
       (SELECT count(*) FILTER (WHERE split = 'val') FROM kept) AS val_after,
       (SELECT count(*) FILTER (WHERE split = 'test') FROM kept) AS test_after,
       (SELECT count(*) FILTER (WHERE lang = 'en') FROM vocab) AS source_vocab_size,
       (SELECT count(*) FILTER (WHERE lang = 'it') FROM vocab) AS target_vocab_size,
       42 AS split_seed""")
def q_data_manifest(spark, sf_dir):
    """The manifest counts of one run."""
    pairs = _pairs(spark, sf_dir)
    p = prepare(pairs, SEED, None, SEQ_LEN, with_decoder_mask=False)
    m = M.data_manifest(M.manifest_counts(p.split, p.kept, p.vocab, "en", "it"), SEED,
                        {"kind": "local_parquet", "filename": "conversations.parquet"})
    return m.select(
        F.col("original_examples").cast("bigint"), F.col("selected_examples").cast("bigint"),
        *[F.col(f"split_before_filter.{s}").cast("bigint").alias(f"{s}_before") for s in ("train", "val", "test")],
        *[F.col(f"split_after_filter.{s}").cast("bigint").alias(f"{s}_after") for s in ("train", "val", "test")],
        F.col("source_vocab_size").cast("bigint"), F.col("target_vocab_size").cast("bigint"), "split_seed")


def _manifest_counts(spark, pairs, seed):
    """The counts of one seed, computed once."""
    p = prepare(pairs, seed, None, SEQ_LEN, with_decoder_mask=False)
    counts = M.manifest_counts(p.split, p.kept, p.vocab, "en", "it")
    return spark.createDataFrame(counts.collect(), counts.schema)  # one row


def _manifest_of(counts, seed, run_id, software, digest="a"):
    return M.data_manifest(counts, seed, {"kind": "local_parquet", "filename": "conversations.parquet", "sha256": digest},
                           software, run_id)


def _three_manifests(spark, sf_dir):
    """A baseline, a rerun with another library version, and another seed."""
    pairs = _pairs(spark, sf_dir)
    counts, other = _manifest_counts(spark, pairs, SEED), _manifest_counts(spark, pairs, SEED + 1)
    return (_manifest_of(counts, SEED, "base", {"pyspark": "4.1.2"})
            .unionByName(_manifest_of(counts, SEED, "rerun", {"pyspark": "4.1.3"}))
            .unionByName(_manifest_of(other, SEED + 1, "seed43", {"pyspark": "4.1.2"})), counts)


_MANIFEST_KEYS = M.BLOCKING_KEYS + M.WARNING_KEYS


def _manifest_diff_sql() -> str:
    cmp_b = " UNION ALL\n    ".join(
        f"SELECT '{k}' AS key, a.{k} = b.{k} AS same FROM m_base a, m_b b"
        for k in ("original_examples", "selected_examples", "split_before_filter", "split_after_filter",
                  "source_vocab_size", "target_vocab_size"))
    keys = ", ".join(f"('{k}')" for k in _MANIFEST_KEYS)
    return _with(O.split_ctes(SEED), O.vocab_ctes(), O.kept_cte(SEQ_LEN),
                 O.split_ctes(SEED + 1, sfx="_b", with_pairs=False), O.vocab_ctes(sfx="_b"),
                 O.kept_cte(SEQ_LEN, "_b"), O.manifest_counts_cte("m_base"), O.manifest_counts_cte("m_b", "_b")) + f"""
, seed_b AS (
    {cmp_b} UNION ALL
    SELECT 'source', true UNION ALL SELECT 'split_seed', false UNION ALL
    SELECT 'tokenizer_training_split', true UNION ALL SELECT 'software', true)
SELECT 'rerun' AS run_id, key, CASE WHEN key = 'software' THEN 'warn' ELSE 'same' END AS severity
FROM (VALUES {keys}) k(key)
UNION ALL
SELECT 'seed43', key, CASE WHEN same THEN 'same' WHEN key = 'software' THEN 'warn' ELSE 'block' END FROM seed_b"""


@query("manifest_diff", _manifest_diff_sql())
def q_manifest_diff(spark, sf_dir):
    """Three runs over the same pairs: the baseline, a rerun with another
    library version (warn only) and a run with another seed (blocked)."""
    runs, _ = _three_manifests(spark, sf_dir)
    return M.manifest_diff(M.manifest_long(runs), "base").select("run_id", "key", "severity")


@query("resume_verdict", """
SELECT * FROM (VALUES ('rerun', true, CAST(1 AS BIGINT)), ('seed43', false, CAST(0 AS BIGINT)),
                      ('changed', false, CAST(0 AS BIGINT))) v(run_id, resume_allowed, warnings)""")
def q_resume_verdict(spark, sf_dir):
    """May each run resume the baseline: a new library version warns, another
    seed or a corpus of the same counts but other content blocks."""
    runs, counts = _three_manifests(spark, sf_dir)
    runs = runs.unionByName(_manifest_of(counts, SEED, "changed", {"pyspark": "4.1.2"}, digest="b"))
    return M.resume_allowed(M.manifest_diff(M.manifest_long(runs), "base"))


# ---------------------------------------------------------- streaming, plans

@query("stream_epoch_loss", _with(O.batches_cte()) + """
SELECT run_id, epoch, phase, round(sum(loss * tokens) / sum(tokens), 9) AS epoch_loss,
       count(*) AS batches, CAST(sum(tokens) AS BIGINT) AS tokens
FROM batches GROUP BY run_id, epoch, phase""")
def q_stream_epoch_loss(spark, sf_dir):
    """Batch-loss files arrive in three drops (training, validation, then
    all other batches); the streaming aggregation
    (available-now trigger, restarted from its checkpoint) keeps the epoch
    losses current."""
    from ..schemas import BATCH_LOSS
    from ..streaming.epoch_stream import latest_epoch_losses, start_epoch_history

    base = _scratch(spark, "stream")
    batches = FX.batch_losses(spark, sf_dir).select(*[f.name for f in BATCH_LOSS.fields])
    for i, part in enumerate([F.col("phase") == "train", F.col("phase") == "val", ~F.col("phase").isin("train", "val")]):
        batches.where(part).write.parquet(f"{base}/inbox/drop{i}")
        start_epoch_history(spark, f"{base}/inbox/*", f"{base}/out", f"{base}/ckpt").awaitTermination()
    r = latest_epoch_losses(spark, f"{base}/out")
    return r.select("run_id", "epoch", "phase", _r("epoch_loss").alias("epoch_loss"),
                    F.col("batches").cast("bigint"), "tokens")


@query("stream_progress", _with(O.history_cte()) + """
SELECT run_id, epoch, round(val_loss, 9) AS val_loss,
       round(min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS best_so_far,
       coalesce(val_loss < coalesce(min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'infinity'::DOUBLE), false) AS improved
FROM history""")
def q_stream_progress(spark, sf_dir):
    """History rows land in two drops (first and second half of the epochs);
    the stateful stream decides best-so-far and improvement per epoch,
    restarting from its checkpoint between the drops."""
    from ..streaming.progress_stream import HISTORY_ROWS, start_progress

    base = _scratch(spark, "progress")
    hist = _history(spark, sf_dir).select(*[f.name for f in HISTORY_ROWS.fields])
    for i, part in enumerate([F.col("epoch") <= 15, F.col("epoch") > 15]):
        hist.where(part).write.parquet(f"{base}/inbox/drop{i}")
        start_progress(spark, f"{base}/inbox/*", f"{base}/out", f"{base}/ckpt").awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select("run_id", "epoch", _r("val_loss").alias("val_loss"), _r("best_so_far").alias("best_so_far"),
                      "improved")


@query("translate", _with(O.split_ctes(SEED), O.vocab_ctes()) + f"""
, src AS (SELECT u.conv_id * 1000000000 + u.turn AS id, u.text FROM conversations u WHERE u.role = 'user'),
fit AS (SELECT *, CASE WHEN len(regexp_extract_all(text, '{O.PRE_RE2}')) + 2 <= {SEQ_LEN} THEN 'ok' ELSE 'too_long' END
               AS status FROM src),
tok AS (SELECT id, generate_subscripts(t, 1) AS pos, unnest(t) AS token
        FROM (SELECT id, regexp_extract_all(text, '{O.PRE_RE2}') AS t FROM fit)),
enc AS (SELECT t.id, list(coalesce(v.id, 0) ORDER BY t.pos) AS ids FROM tok t
        LEFT JOIN vocab v ON v.lang = 'en' AND v.token = t.token GROUP BY t.id),
e2 AS (SELECT f.id, f.text, f.status, {O.encoder_input('coalesce(e.ids, []::INTEGER[])', SEQ_LEN)} AS ei
       FROM fit f LEFT JOIN enc e USING (id)),
hyp AS (SELECT id, text, status, {_echo_hypothesis_sql('ei')} AS h FROM e2),
dec AS (SELECT id, generate_subscripts(h, 1) AS pos, unnest(h) AS tid FROM hyp),
txt AS (SELECT d.id, string_agg(v.token, ' ' ORDER BY d.pos) AS t
        FROM dec d JOIN vocab v ON v.lang = 'it' AND v.id = d.tid WHERE d.tid > 3 GROUP BY d.id)
SELECT h.id, h.text, h.status, CASE WHEN h.status = 'ok' THEN coalesce(x.t, '') END AS translation
FROM hyp h LEFT JOIN txt x USING (id)""")
def q_translate(spark, sf_dir):
    """Every user turn translated by the stand-in model with the vocabularies
    of the training split; one that does not fit has a status instead."""
    from .evaluate import echo_model, translate

    vocab = V.train_vocab(_split(spark, sf_dir), {"en": "src_text", "it": "tgt_text"})
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where(F.col("role") == "user")
    texts = c.select((F.col("conv_id") * 1000000000 + F.col("turn")).alias("id"), "text")
    return translate(texts, ["id"], "text", vocab, echo_model, SEQ_LEN)


@query("evaluate_test", _inputs_sql(f"""
, first_test AS (
  SELECT id, src_text, tgt_text, {O.encoder_input('src_ids', SEQ_LEN)} AS ei
  FROM encoded WHERE split = 'test' ORDER BY shuffle_rank LIMIT {EVAL_SAMPLES}),
hyp AS (SELECT id, src_text, tgt_text, {_echo_hypothesis_sql('ei')} AS h FROM first_test),
dec AS (SELECT id, generate_subscripts(h, 1) AS pos, unnest(h) AS tid FROM hyp),
txt AS (SELECT d.id, string_agg(v.token, ' ' ORDER BY d.pos) AS text
        FROM dec d JOIN vocab v ON v.lang = 'it' AND v.id = d.tid WHERE d.tid > 3 GROUP BY d.id)
SELECT h.id, h.src_text AS source, h.tgt_text AS reference, coalesce(x.text, '') AS prediction
FROM hyp h LEFT JOIN txt x USING (id)"""))
def q_evaluate_test(spark, sf_dir):
    """Test evaluation end to end: the first 20 test rows (split order)
    scored by the stand-in model, truncated and decoded with the target
    vocabulary. (The corpus metrics of the same plan are ``evaluate``'s
    second result; their SQL checks are the ``bleu``/``cer``/``wer`` queries.)"""
    from .evaluate import echo_model, evaluate

    p = _prepared(spark, sf_dir)
    predictions, _ = evaluate(p, echo_model, SEQ_LEN, EVAL_SAMPLES)
    return predictions


@query("evaluate_run", _inputs_sql(f"""
, first_test AS (
  SELECT id, src_text, tgt_text, {O.encoder_input('src_ids', SEQ_LEN)} AS ei
  FROM encoded WHERE split = 'test' ORDER BY shuffle_rank LIMIT {EVAL_SAMPLES}),
{O.history_cte()}
SELECT (SELECT count(*) FROM first_test) AS decoded_test_examples,
       (SELECT count(*) FROM kept WHERE split = 'test') AS all_test_examples, 'best.pt' AS checkpoint,
       (SELECT arg_min(epoch, (val_loss, epoch)) FILTER (WHERE val_loss IS NOT NULL) FROM history WHERE run_id = 'run1') AS best_epoch"""))
def q_evaluate_run(spark, sf_dir):
    """The evaluation half of a run in its folder: metrics over the first 20
    filtered test rows, counts over all of them, the run's best epoch. (The
    metric values have their own queries; here both scopes are checked.)"""
    from .evaluate import echo_model, evaluate_run

    loss = L.cross_entropy(FX.logits(spark, sf_dir), "logits", "label", 0.1)
    r = evaluate_run(spark, _prepared(spark, sf_dir), _scratch(spark, "run"), "run1", echo_model, loss,
                     _history(spark, sf_dir), SEQ_LEN, EVAL_SAMPLES)
    return r.select("decoded_test_examples", "all_test_examples", "checkpoint", "best_epoch")


__all__ = ["registry"]
