"""SentencePiece encoding by a table of distinct marked words.

A model whose pieces never hold a marker after another character cuts a text at every such place: "▁▁new▁world" is "▁▁new" and
"▁world", and no merge crosses from one to the next. So each distinct marked word is segmented once, and a document's ids are its
words' ids joined by position. All words of all texts are counted; the common ones go to every task as a table of bounded size. The
others have few occurrences each. With tail="join" they are segmented once too and joined to their occurrences by a shuffle; with
tail="segment" a task segments those it meets, once a batch, as moving them and the texts costs more than segmenting them again.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, checkpoint, typed

MODEL = "piece_bpe_32k.model"
MARK = "▁"
WORD = f"{MARK}+[^{MARK}]*"
#: The table that every task gets has at most so many words, and so many bytes of words and ids.
COMMON_WORDS, COMMON_BYTES = 100_000, 32 << 20
#: Bytes of ids in an Arrow batch, but for a longer document.
BATCH_BYTES = 4 << 20


def marked_words(text: Column) -> Column:
    """The marked words of a text in order: spaces are markers, and one marker stands before all (null and empty: none)."""
    marked = F.concat(F.lit(MARK), F.translate(text, " ", MARK))
    return F.when(F.length(text) > 0, F.regexp_extract_all(marked, F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))


@functools.cache  # one a worker process, not one a task
def processor(path: str):
    """The library's processor, once it is sure that words can be segmented apart."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(sp.get_piece_size()):
        if re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)):
            raise ValueError(f"piece {i} of {path} goes on after a marker: words cannot be segmented apart")
    # spaces must be kept as they are, and the marker before the text be the library's own
    if sp.encode("  a ", out_type=str, num_threads=1)[-1] != MARK or sp.decode(sp.encode("  a ", num_threads=1)) != "  a ":
        raise ValueError(f"{path} drops or changes white space")
    return sp


def _ids_of(sp, words: list[str]) -> list[list[int]]:
    """The ids of marked words. The library puts a text's first marker back, but not before nothing."""
    alone = [sp.piece_to_id(MARK)]
    return [i if len(w) > 1 else alone for w, i in zip(words, sp.encode([w[1:] for w in words], num_threads=1))] if words else []


def _segment(path: str):
    """word batches with the ids of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = _ids_of(processor(path), b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the distinct marked words of all texts, and how often they occur."""
    return docs.select(F.explode(marked_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _table(words: DataFrame, path: str) -> DataFrame:
    """word, ids"""
    return words.select("word").mapInArrow(_segment(path), "word string, ids array<int>")


def _common(counts: DataFrame, words: int, size: int) -> Column:
    """Which words are common: the most frequent, as far as the bounds go; a word has no more ids than bytes. Frequencies are compared
    by eighths of a power of two, so the driver sees some five hundred sums at most."""
    level = F.floor(F.log2("n") * 8).cast("int")
    least, have, used = None, 0, 0
    for lv, n, b in sorted(counts.groupBy(level.alias("level")).agg(F.count("*"), F.sum(5 * F.octet_length("word"))).collect(), reverse=True):
        have, used = have + n, used + b
        if have > words or used > size:
            break
        least = lv
    return F.lit(False) if least is None else level >= least


def _occurrences(known):
    """For documents (doc_id, digest, text): doc_id, digest, place and word of each word that is not in the common table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, find = known.value, re.compile(WORD).findall
        for b in batches:
            docs, digests, places, words = [], [], [], []
            for doc_id, digest, text in zip(*(c.to_pylist() for c in b.columns)):
                for at, w in enumerate(_words(find, text)):
                    if w not in have:
                        docs.append(doc_id), digests.append(digest), places.append(at), words.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(digests, pa.int64()), pa.array(places, pa.int32()), pa.array(words, pa.string())], names=["doc_id", "digest", "place", "word"])

    return run


def _words(find, text: str | None) -> list[str]:
    return find(MARK + text.replace(" ", MARK)) if text else []


def _join(known, path: str):
    """Documents (doc_id, text, rare) with their ids: those of common words from the table, the others from rare by place, or, where
    that is null, segmented here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, find = known.value, re.compile(WORD).findall
        for b in batches:
            docs, parts, size, met = [], [], 0, {}
            for doc_id, text, rare in zip(*(c.to_pylist() for c in b.columns)):
                words = _words(find, text)
                if rare is None:
                    new = list({w for w in words if w not in have and w not in met})
                    met.update(zip(new, map(_packed, _ids_of(processor(path), new))))
                    ids = b"".join([have[w] if w in have else met[w] for w in words])
                else:
                    placed = {r["place"]: _packed(r["ids"]) for r in rare}
                    ids = b"".join([placed[at] if at in placed else have[w] for at, w in enumerate(words)])
                docs.append(doc_id), parts.append(ids)
                size += len(ids)
                if size >= BATCH_BYTES:
                    yield _ids(docs, parts)
                    docs, parts, size, met = [], [], 0, {}
            if docs:
                yield _ids(docs, parts)

    return run


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<i4").tobytes()


def _ids(docs: list, parts: list[bytes]) -> pa.RecordBatch:
    ends = np.cumsum([0] + [len(p) // 4 for p in parts]).astype("i4")
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), lists], names=["doc_id", "ids"])


def encode(docs: DataFrame, model_path: str | None = None, common_words: int = COMMON_WORDS, common_bytes: int = COMMON_BYTES, tail: str = "segment") -> DataFrame:
    """doc_id, ids: each document's ids, the same as sentencepiece's encode(text) without begin and end.

    A null text is an empty one and has no ids. Rows that repeat are encoded as often as they come, also with one doc_id and several
    texts; a null doc_id stays null. An empty table gives no rows. Other columns, whatever their names, are ignored. Texts of any
    length are encoded whole. Results depend neither on common_words and common_bytes, which bound what each task is sent, nor on
    tail, which says how the other words get their ids (see above).
    """
    import public_tokenizers

    if tail not in ("segment", "join"):
        raise ValueError("tail is segment or join")
    spark, path = docs.sparkSession, model_path or public_tokenizers.path(MODEL)
    docs, out = typed(docs, "doc_id long, text string"), "doc_id long, ids array<int>"
    with Scratch(spark) as scratch:
        counts = scratch.save(word_counts(docs))
        common = _common(counts, common_words, common_bytes)
        known = spark.sparkContext.broadcast({r[0]: _packed(r[1]) for r in _table(counts.where(common), path).collect()})
        rest = checkpoint(_table(counts.where(~common), path)) if tail == "join" else None
    if rest is None:
        return docs.withColumn("rare", F.lit(None).cast("array<struct<place:int,ids:array<int>>>")).mapInArrow(_join(known, path), out)

    # equal rows have one list, in which places repeat without harm
    keyed = docs.withColumn("digest", F.xxhash64("text"))
    places = keyed.select("doc_id", "digest", "text").mapInArrow(_occurrences(known), "doc_id long, digest long, place int, word string")
    lists = places.join(rest, "word").groupBy("doc_id", "digest").agg(F.collect_list(F.struct("place", "ids")).alias("rare"))
    same = keyed["doc_id"].eqNullSafe(lists["doc_id"]) & (keyed["digest"] == lists["digest"])
    return keyed.join(lists, same, "left").select(keyed["doc_id"], "text", F.coalesce("rare", F.array().cast("array<struct<place:int,ids:array<int>>>")).alias("rare")).mapInArrow(_join(known, path), out)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)
        for b in batches:
            ids = b.column("ids").fill_null([])
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            start, texts = 0, []
            for i in range(b.num_rows):
                texts.append(sp.decode(flat[ends[i] : ends[i + 1]].tolist()))
                if i + 1 == b.num_rows or ends[i + 1] - ends[start] >= BATCH_BYTES // 4:
                    yield b.slice(start, i + 1 - start).append_column("decoded", pa.array(texts, pa.string()))
                    start, texts = i + 1, []

    return run


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """encoded (doc_id, ids) with decoded, the library's decode(ids): "" where there are no ids or null."""
    import public_tokenizers

    e = typed(encoded, "doc_id long, ids array<int>")
    return e.mapInArrow(_decode(model_path or public_tokenizers.path(MODEL)), "doc_id long, ids array<int>, decoded string")


def op11_distinct_chunk_pieces(spark, sf_dir: str) -> DataFrame:
    """All documents in pieces of piece_bpe_32k and back, as digests."""
    d = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    digest = lambda text: F.sha2(text, 256)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(ids).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
