"""Token-count rollups that are maintained by deltas.

A change is an insert (after image), a delete (before image) or a revision (both). Each image becomes one signed
row: +1 document and +tokens after, -1 and -tokens before. A batch is the sum of its signed rows by source,
language and tokenizer version, written once as a folder of the log; totals are the sums over the committed
batches, so their order doesn't matter, and a batch costs by its changes, never by what was counted before.

Commits are idempotent: a batch is written to a name of its own and then renamed to ``batch=<id>``. If that name
exists the batch was committed before, and the new copy is dropped. A driver that dies before the rename leaves
nothing that readers see.

Batch ids are any text; folders are named by their percent-encoded form.

Defined cases: null source, language or version is the group ``''``; null token counts are 0; groups whose
documents and tokens all return to 0 drop out of the totals; an empty batch is committed and changes nothing;
repeated rows in one batch each count; other columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm.common import bound_batches, discard, materialise, shared_dir, texts, trimmed
from textward.llm.decontaminate import words

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")
LOG = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"

#: A vocabulary of ranks on every node, from the installed package of public vocabularies, and its version's name.
VOCABULARY, VERSION = "byte_bpe_50k.tiktoken", "byte_bpe_50k"
#: Words, by white space; a second version to revise to.
WORDS_VERSION = "words"


class Counter:
    """Tokens of a text under a byte-level vocabulary."""

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.code = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(self, texts_: list[str]) -> list[int]:
        return [len(x) for x in self.code.encode_ordinary_batch(texts_, num_threads=1)]


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, lang, n_chars, n_tokens, n_words, n_terms (words of letters and digits), text_mark (a hash of the text) of every whole text."""
    bound_batches(docs.sparkSession)
    rows = texts(docs, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(vocabulary) or _COUNTERS.setdefault(vocabulary, Counter(vocabulary))
        for batch in trimmed(batches):
            body = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), batch.column("source").cast(pa.string()), batch.column("lang").cast(pa.string()), pa.array(map(len, body), pa.int64()),
                    pa.array(counter.count(body), pa.int64()), pa.array([len(t.encode("utf-8", "surrogatepass").split()) for t in body], pa.int64()),
                    pa.array([len(words(t)) for t in body], pa.int64()), pa.array([hashlib.blake2b(t.encode(), digest_size=16).digest() for t in body], pa.binary()),
                ],
                names=["doc_id", "source", "lang", "n_chars", "n_tokens", "n_words", "n_terms", "text_mark"],
            )

    return rows.mapInArrow(run, "doc_id long, source string, lang string, n_chars long, n_tokens long, n_words long, n_terms long, text_mark binary")


def image(rows: DataFrame, sign: int, tokenizer: str, tokens: str = "n_tokens") -> DataFrame:
    """Signed rows: +1 for what is there from now on, -1 for what was there before."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    count = lambda c, to: (F.coalesce(F.col(c).cast("long"), F.lit(0)) * sign).alias(to)
    return rows.select(text("source"), text("lang"), F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("n_docs"), count(tokens, "n_tokens"), count("n_chars", "n_chars"))


def summed(signed: DataFrame) -> DataFrame:
    return signed.groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS))


class Rollup:
    """A log of committed batches in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/textward/rollup-{uuid.uuid4().hex}"
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        root = self._hadoop.Path(self.path)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(root)

    @staticmethod
    def _named(batch: str) -> str:
        return urllib.parse.quote(batch, safe="").replace(".", "%2E")

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def committed(self) -> set[str]:
        """Ids of the batches in the totals."""
        return {urllib.parse.unquote(n[6:]) for f in self._fs.listStatus(self._at("")) if (n := f.getPath().getName()).startswith("batch=")}

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add a batch of signed rows; False, and nothing changes, if it was committed before."""
        if batch in self.committed():
            return False
        draft, name = f".draft-{uuid.uuid4().hex}", f"batch={self._named(batch)}"
        summed(signed).write.parquet(f"{self.path}/{draft}")
        if self._fs.exists(self._at(name)) or not self._fs.rename(self._at(draft), self._at(name)):
            self._fs.delete(self._at(draft), True)
            return False
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer and the additive totals of the committed batches."""
        parts = [f"{self.path}/batch={self._named(b)}" for b in sorted(self.committed())]
        log = self.spark.read.schema(LOG).parquet(*parts) if parts else self.spark.createDataFrame([], LOG)
        return summed(log).where(" OR ".join(f"{c} <> 0" for c in SUMS))


def corpus_history(docs: DataFrame, path: str | None = None) -> Rollup:
    """The rollup of a corpus through its history, every batch sent twice as a retrying sender would:

    ``load`` inserts every document under both tokenizer versions; ``copies`` deletes every later copy (by doc_id, a
    null last) of an equal text, repeated rows among them; ``recount`` revises the word counts of what is left from
    white-space words to words of letters and digits.

    The deletes are summed as all rows less the first of each text. The firsts come from one aggregate that combines
    before its shuffle, so a hot group of copies is one row a task and nothing is joined back to it.
    """
    counted = materialise(count_tokens(docs), "counts")
    order = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("order")
    least = F.min(F.struct(order, "source", "lang", "n_chars", "n_tokens", "n_words", "n_terms"))
    first = materialise(counted.groupBy("text_mark").agg(least.alias("f")).select("f.*"), "firsts")
    log = Rollup(docs.sparkSession, path)
    both = lambda rows, sign: image(rows, sign, VERSION).unionByName(image(rows, sign, WORDS_VERSION, "n_words"))
    batches = {
        "load": both(counted, 1),
        "copies": both(counted, -1).unionByName(both(first, 1)),
        "recount": image(first, -1, WORDS_VERSION, "n_words").unionByName(image(first, 1, WORDS_VERSION, "n_terms")),
    }
    for name, signed in batches.items():
        log.commit(name, signed)
        log.commit(name, signed)
    discard(counted, first)
    return log
