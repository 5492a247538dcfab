"""Training-data pipeline over `documents`: toxicity, near duplicates, secrets, mixing, packing.

Each stage is (name, function of (spark, docs, sf_dir)). All but the last return the columns of
`documents`; what a stage decides is in the rows it returns:

1. toxicity: documents whose score by the nearest labelled examples is 0.5 or more go;
2. near_duplicates: of each class of near duplicates the document with the least id stays;
3. secrets: secrets in texts are replaced by a mark, n_chars follows; no document goes;
4. mixing: documents of low predicted quality are halved in weight and the others raised to keep the
   corpus' tokens, so each other document stays and some appear twice;
5. packing: documents become pieces of sequences of 2048 tokens, with their ids' checksums.

Any column may be null, texts may be empty or very long, rows may repeat, tables may be empty and have
further columns of any name, which the first four stages keep; each stage says what then comes out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm import common
from tideglass.llm.dart_minhash import drop_near_duplicates
from tideglass.llm.knn_toxicity import drop_toxic, fit
from tideglass.llm.mixing import mix
from tideglass.llm.packing import pack_documents
from tideglass.llm.secret_scan import redact

TOXIC = 0.5
LOW_QUALITY = {"0": 0.5}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have no words and stay; equal rows stay or go together; without usable labels all stay."""
    return drop_toxic(docs, fit(docs, common.table(spark, sf_dir, "labels")), TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are one class; rows of null id stand behind all others; of equal rows one stays."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts stay null, texts without findings stay as they are; every row stays."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without tokens stay once; equal rows get equally many copies; without labels all stay once."""

    def weights(natural: dict[str, float]) -> dict[str, float]:
        return {d: share * LOW_QUALITY.get(d, 1.0) for d, share in natural.items()}

    return mix(docs, common.table(spark, sf_dir, "labels"), F.col("quality"), weights)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null text counts as empty and is its end id alone; each of equal rows is packed; an empty table gives no pieces."""
    import public_tokenizers

    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: No SQL expresses the nearest-example search, the signatures, the forest or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
