"""Fixed schemas and constants shared by every module."""

from pyspark.sql import types as T

# Special tokens in id order. They must keep these ids for
# vocabularies, encoded arrays and decoded text to agree.
SPECIAL_TOKENS = ["[UNK]", "[PAD]", "[SOS]", "[EOS]"]
UNK_ID, PAD_ID, SOS_ID, EOS_ID = 0, 1, 2, 3
FIRST_WORD_ID = len(SPECIAL_TOKENS)

# Vocabulary trainer defaults (cap includes the specials).
VOCAB_CAP = 30000
MIN_FREQUENCY = 2

# Split fractions and label smoothing of the experiment.
SPLIT_FRACTION = 0.1
LABEL_SMOOTHING = 0.1
MIN_SELECTED_ROWS = 10

VOCAB = T.StructType([
    T.StructField("lang", T.StringType(), False),
    T.StructField("token", T.StringType(), False),
    T.StructField("id", T.IntegerType(), False),
])

BATCH_LOSS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("phase", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("tokens", T.LongType()),
])

HISTORY = T.StructType([
    T.StructField("epoch", T.IntegerType()),
    T.StructField("train_loss", T.DoubleType()),
    T.StructField("val_loss", T.DoubleType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("global_step", T.IntegerType()),
])

PREDICTIONS = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("reference", T.StringType()),
    T.StructField("prediction", T.StringType()),
])
