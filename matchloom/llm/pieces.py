"""SentencePiece encoding and decoding with a distinct-chunk table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from matchloom.llm.common import free_memory, table

#: Distinct chunks kept by a task, and the length up to which a chunk is kept; others are segmented where they occur.
TABLE_CHUNKS, KEPT_CHARS = 150_000, 64
#: Texts whose ids and decoded texts a task holds before it hands them on.
BATCH_ROWS = 128
MARK = "▁"


class ChunkTable:
    """Ids of distinct marked words: a run of markers with what follows up to the next marker.

    Exact where no piece has a marker after another character, as then no merge crosses from one chunk to the next,
    and where the normalizer does nothing but mark spaces and put one marker in front. __init__ checks both on the
    model; `whole` is set where they don't hold, and texts then go to the library undivided.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        spec = model.normalizer_spec
        plain = spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
        bytes_ = sum(p.type == 6 for p in model.pieces) == 256  # so nothing is unknown
        cross = any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces)
        self.whole = cross or not plain or not bytes_ or model.trainer_spec.treat_whitespace_as_suffix
        self.split = re.compile(f"{MARK}+[^{MARK}]*").findall
        self.ids: dict[str, bytes] = {}
        self.bos, self.eos = (np.array([i], "<u4").tobytes() for i in (self.sp.bos_id(), self.sp.eos_id()))
        self.mark = np.array([self.sp.piece_to_id(MARK)], "<u4").tobytes()  # the library adds no marker to an empty text
        self.leads = np.array([p.piece.startswith(MARK) for p in model.pieces])

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks that the table lacks.

        Chunks of one marker and more go to the library side by side: a piece that starts with the marker starts a
        chunk. Others, where markers could run together, go one by one.
        """
        plain = [c for c in chunks if c[1:2] not in ("", MARK)]
        found = {c: np.array(self.sp.encode(c[1:], num_threads=1), "<u4").tobytes() for c in chunks if c[1:2] == MARK}
        found[MARK] = self.mark
        if plain:
            ids = np.array(self.sp.encode("".join(plain)[1:], num_threads=1, return_type="numpy"), "<u4")  # the library puts the first marker there itself
            starts = (4 * np.flatnonzero(self.leads[ids])).tolist()
            if len(starts) == len(plain):
                every = ids.tobytes()
                found.update(zip(plain, [every[a:b] for a, b in zip(starts, [*starts[1:], len(every)])]))
            else:  # a model whose pieces don't show where chunks begin
                found.update({c: np.array(self.sp.encode(c[1:], num_threads=1), "<u4").tobytes() for c in plain})
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids with begin and end as little-endian 32-bit integers, and the text that decode() makes of them."""
        if not text:
            return self.bos + self.eos, ""
        if self.whole:
            ids = self.sp.encode(text, add_bos=True, add_eos=True)
            return np.array(ids, "<u4").tobytes(), self.sp.decode(ids)
        chunks = self.split(MARK + text.replace(" ", MARK))
        known = self.ids
        if missing := set(chunks).difference(known):
            new = self.learn(missing)
            if len(known) + len(new) > TABLE_CHUNKS:
                known.clear()
                new |= self.learn(set(chunks).difference(new))
            kept = {c: ids for c, ids in new.items() if len(c) <= KEPT_CHARS} if len(new) <= TABLE_CHUNKS else {}
            self.ids.update(kept)
            if len(kept) < len(new):
                known = known | new
        ids = b"".join([self.bos, *map(known.__getitem__, chunks), self.eos])
        return ids, self.sp.decode(np.frombuffer(ids, np.int32), num_threads=1)


def encode(df: DataFrame, id_col: str, text_col: str, model: str, keep: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, with keep, ids (array of int) and decoded, one row for each row.

    A null text counts as empty and has the begin and end ids only. Rows and ids may repeat or be null. A task holds a
    bounded table of the distinct chunks that it has met, segments each once, and joins ids back by position; text is
    never shuffled. `model` is a path on every executor.
    """
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(model)
        for batch in (whole.slice(at, BATCH_ROWS) for whole in batches for at in range(0, whole.num_rows, BATCH_ROWS)):
            out: list[list] = [[] for _ in fields]
            for text in batch.column(1):
                ids, decoded = chunks.encode(text.as_py() or "")
                row = [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                row += [np.frombuffer(ids, "<u4").astype(np.int32), decoded] if keep else []
                for x, v in zip(out, row):
                    x.append(v)
            columns = [batch.column(0), *[pa.array(x, t) for x, (_, t) in zip(out, fields)]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *[c for c, _ in fields]])
        del chunks
        free_memory()

    inner = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    said = inner.drop("text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    said = said.add("ids", ArrayType(IntegerType())).add("decoded", "string") if keep else said
    return inner.mapInArrow(run, said).withColumnRenamed("id", id_col)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text", model_path(), keep=False)
