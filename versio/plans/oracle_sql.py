"""DuckDB SQL equivalents of the registered queries (the correctness
oracle). Written independently of the Spark plans: window functions and
list lambdas over the same Parquet views.

DuckDB differences handled here: RE2 has no ``(?U)`` (explicit Unicode
classes instead) and no look-ahead (the plain word/punctuation pattern is
used; the test tables hold no literal special tokens), lists are 1-based,
``levenshtein`` counts bytes (characters are first mapped to one ASCII
byte each per pair, with an exact list programme for larger alphabets),
and rounding half-even is ``round_even``.
"""

from ..functions.text import WORD_RE
from ..sources.pairs import PAIRS_SQL

# RE2 form of the word/punctuation pre-tokenizer.
PRE_RE2 = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+|[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s]+"
WORD_RE2 = WORD_RE


def pairs_cte() -> str:
    return f"pairs AS ({PAIRS_SQL})"


def split_ctes(seed: int = 42, max_samples: int | None = None, sfx: str = "", with_pairs: bool = True) -> str:
    sel = "count(*) OVER ()" if max_samples is None else f"least(count(*) OVER (), {int(max_samples)})"
    size = "greatest(1, round_even(selected * 0.1::DOUBLE, 0))"
    head = f"{pairs_cte()},\n" if with_pairs else ""
    return f"""{head}ranked{sfx} AS (
  SELECT id, en AS src_text, it AS tgt_text,
         row_number() OVER (ORDER BY md5(concat('{seed}', ':', id)), id) AS shuffle_rank,
         {sel} AS selected
  FROM pairs),
split{sfx} AS (
  SELECT id, src_text, tgt_text, shuffle_rank, selected,
         CASE WHEN shuffle_rank <= {size} THEN 'test'
              WHEN shuffle_rank <= 2 * {size} THEN 'val'
              ELSE 'train' END AS split
  FROM ranked{sfx} WHERE shuffle_rank <= selected)"""


def vocab_ctes(cap: int = 30000, min_frequency: int = 2, sfx: str = "") -> str:
    return f"""train_tokens{sfx} AS (
  SELECT 'en' AS lang, unnest(regexp_extract_all(src_text, '{PRE_RE2}')) AS token FROM split{sfx} WHERE split = 'train'
  UNION ALL
  SELECT 'it' AS lang, unnest(regexp_extract_all(tgt_text, '{PRE_RE2}')) AS token FROM split{sfx} WHERE split = 'train'),
word_counts{sfx} AS (SELECT lang, token, count(*) AS count FROM train_tokens{sfx} GROUP BY lang, token),
words{sfx} AS (
  SELECT lang, token, CAST(row_number() OVER (PARTITION BY lang ORDER BY count DESC, token) + 3 AS INTEGER) AS id
  FROM word_counts{sfx} WHERE count >= {min_frequency}
  QUALIFY id < {cap}),
vocab{sfx} AS (
  SELECT lang, token, id FROM words{sfx}
  UNION ALL
  SELECT l.lang, s.token, CAST(s.id AS INTEGER) FROM (VALUES ('en'), ('it')) l(lang)
  CROSS JOIN (VALUES ('[UNK]', 0), ('[PAD]', 1), ('[SOS]', 2), ('[EOS]', 3)) s(token, id))"""


def kept_cte(seq_len: int, sfx: str = "") -> str:
    return f"""kept{sfx} AS (
  SELECT * FROM split{sfx}
  WHERE len(regexp_extract_all(src_text, '{PRE_RE2}')) + 2 <= {seq_len}
    AND len(regexp_extract_all(tgt_text, '{PRE_RE2}')) + 1 <= {seq_len})"""


def manifest_counts_cte(name: str, sfx: str = "") -> str:
    """Manifest counts of one run; split counts as lists in split-name order."""
    per_split = lambda table: f"""(SELECT list(coalesce(k.c, 0) ORDER BY v.s) FROM (VALUES ('test'), ('train'), ('val')) v(s)
             LEFT JOIN (SELECT split, count(*) AS c FROM {table} GROUP BY split) k ON k.split = v.s)"""  # noqa: E731
    return f"""{name} AS (
  SELECT (SELECT count(*) FROM pairs) AS original_examples,
         (SELECT max(selected) FROM split{sfx}) AS selected_examples,
         {per_split(f"split{sfx}")} AS split_before_filter,
         {per_split(f"kept{sfx}")} AS split_after_filter,
         (SELECT count(*) FILTER (WHERE lang = 'en') FROM vocab{sfx}) AS source_vocab_size,
         (SELECT count(*) FILTER (WHERE lang = 'it') FROM vocab{sfx}) AS target_vocab_size)"""


def encode_ctes(source: str = "kept") -> str:
    return f"""sides AS (
  SELECT id, 'src' AS side, 'en' AS lang, regexp_extract_all(src_text, '{PRE_RE2}') AS toks FROM {source}
  UNION ALL
  SELECT id, 'tgt' AS side, 'it' AS lang, regexp_extract_all(tgt_text, '{PRE_RE2}') AS toks FROM {source}),
tok AS (SELECT id, side, lang, generate_subscripts(toks, 1) AS pos, unnest(toks) AS token FROM sides),
enc AS (
  SELECT t.id, t.side, list(coalesce(v.id, 0) ORDER BY t.pos) AS ids
  FROM tok t LEFT JOIN vocab v ON v.lang = t.lang AND v.token = t.token
  GROUP BY t.id, t.side),
encoded AS (
  SELECT k.*, coalesce(s.ids, []::INTEGER[]) AS src_ids, coalesce(g.ids, []::INTEGER[]) AS tgt_ids
  FROM {source} k
  LEFT JOIN enc s ON s.id = k.id AND s.side = 'src'
  LEFT JOIN enc g ON g.id = k.id AND g.side = 'tgt')"""


def pad(n: str) -> str:
    return f"list_resize([]::INTEGER[], greatest({n}, 0), 1)"


def encoder_input(ids: str, s: int) -> str:
    return f"([2] || {ids} || [3] || {pad(f'{s} - len({ids}) - 2')})"


def decoder_input(ids: str, s: int) -> str:
    return f"([2] || {ids} || {pad(f'{s} - len({ids}) - 1')})"


def label(ids: str, s: int) -> str:
    return f"({ids} || [3] || {pad(f'{s} - len({ids}) - 1')})"


def encoder_mask(arr: str) -> str:
    return f"list_transform({arr}, lambda x: CAST(x <> 1 AS INTEGER))"


def decoder_mask(arr: str, s: int) -> str:
    return (f"list_transform(range({s}), lambda i: list_transform({arr}, "
            f"lambda x, j: CAST(x <> 1 AND j - 1 <= i AS INTEGER)))")


def words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{WORD_RE2}')"


def ngram_list(w: str, n: int) -> str:
    return (f"CASE WHEN len({w}) >= {n} THEN list_transform(range(1, len({w}) - {n} + 2), "
            f"lambda i: array_to_string({w}[i:i + {n - 1}], ' ')) ELSE []::VARCHAR[] END")


def batches_cte() -> str:
    return """batches AS (
  SELECT concat('run', event_id % 3) AS run_id, CAST(dayofyear(ts) AS INTEGER) AS epoch,
         CASE event_type WHEN 'click' THEN 'train' WHEN 'view' THEN 'val' ELSE event_type END AS phase,
         event_id AS batch_id, value AS loss,
         CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS tokens, ts
  FROM events)"""


def history_cte() -> str:
    return f"""{batches_cte()},
per_epoch AS (
  SELECT run_id, epoch,
         sum(CASE WHEN phase = 'train' THEN loss * tokens END)
           / sum(CASE WHEN phase = 'train' THEN tokens END) AS train_loss,
         sum(CASE WHEN phase = 'val' THEN loss * tokens END)
           / sum(CASE WHEN phase = 'val' THEN tokens END) AS val_loss,
         count(*) FILTER (WHERE phase = 'train') AS train_batches,
         CAST(round_even(CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DECIMAL(20, 0)) / 1000000, 2) AS DOUBLE)
           AS seconds
  FROM batches GROUP BY run_id, epoch),
history AS (
  SELECT run_id, epoch, train_loss, val_loss, seconds,
         CAST(sum(train_batches) OVER (PARTITION BY run_id ORDER BY epoch
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS global_step
  FROM per_epoch)"""


def _ascii_mapped(text: str, alphabet: str) -> str:
    """``text`` with every character replaced by one ASCII byte: its position
    in the pair's ``alphabet`` (valid while that has at most 127 entries)."""
    return (f"array_to_string(list_transform(string_split({text}, ''), "
            f"lambda ch: chr(list_position({alphabet}, ch))), '')")


def char_edit_sql(h: str, r: str) -> str:
    """Character edit distance: byte ``levenshtein`` on the one-byte mapping
    when the pair has at most 127 distinct characters (the fixtures have at
    most 44), else the exact list dynamic programme over the characters.
    The pair's alphabet is bound once (a one-element list transform); CASE
    evaluates a branch only for the rows that take it."""
    exact = word_edit_sql(f"string_split({h}, '')", f"string_split({r}, '')")
    body = (f"CASE WHEN {h} = '' THEN length({r}) WHEN {r} = '' THEN length({h}) "
            f"WHEN len(a) <= 127 THEN levenshtein({_ascii_mapped(h, 'a')}, {_ascii_mapped(r, 'a')}) "
            f"ELSE {exact} END")
    return f"list_transform([list_distinct(string_split({h} || {r}, ''))], lambda a: {body})[1]"


def word_edit_sql(hw: str, rw: str) -> str:
    """Exact word-level Levenshtein distance as a row-by-row dynamic
    programme over list lambdas (whole texts, any vocabulary size)."""
    return f"""list_reduce(
      list_transform(range(1, len({rw}) + 1), lambda i: i),
      lambda prev, i: list_reduce(
        list_transform(range(1, len({hw}) + 1), lambda j: j),
        lambda row, j: list_append(row, least(prev[j + 1] + 1, row[j] + 1,
                                              prev[j] + CASE WHEN {hw}[j] = {rw}[i] THEN 0 ELSE 1 END)),
        [prev[1] + 1]),
      list_transform(range(0, len({hw}) + 1), lambda j: CAST(j AS BIGINT)))[len({hw}) + 1]"""
