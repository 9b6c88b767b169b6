"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed and rebuilt as a tokenizers pipeline: normaliser (character map, white space rules, the
leading mark), the metaspace marker, the scored unigram lattice or the merges that BPE scores imply, byte fallback and
the matching decoder. Batches of whole texts are normalised, encoded and decoded by that pipeline in the library's threads: two,
or as many as a task has cores if that is more. ``parity`` compares each text's ids with those of the sentencepiece
library under the model file as it is, so that normaliser and splitting are verified too; ``round_trip`` tells whether the
decoded ids are the text again.

Whole texts are encoded. Null and empty texts have no ids and decode to the empty text. Repeated rows give repeated
results; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from skein.llm import piece_model as pm
from skein.llm.common import map_batches, read

#: Threads of the library in a task, at least.
THREADS = 2
#: Texts that go to the library at once: what it makes of them is many times their size, and should stay in the processor's caches.
ROWS = 128


def _decoder(strip: bool):
    """Byte pieces become characters; the leading mark's space goes."""
    from tokenizers import decoders

    steps = [decoders.ByteFallback(), decoders.Fuse()]
    return decoders.Sequence(steps + ([decoders.Strip(" ", 1, 0)] if strip else []))


def rebuild_decoder(model: pm.PieceModel):
    """A tokenizers.Tokenizer that decodes the model's ids: its pieces, by their place, have spaces for marks already."""
    from tokenizers import Tokenizer, models

    made = Tokenizer(models.Unigram([(p.replace(pm.MARK, " "), 0.0) for p, _, _ in model.pieces], unk_id=model.unk_id))
    made.decoder = _decoder(strip=model.add_dummy_prefix)
    return made


def rebuild(model: pm.PieceModel):
    """A tokenizers.Tokenizer that encodes as the SentencePiece model does."""
    from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers, pre_tokenizers

    vocab = {p: k for k, (p, _, _) in enumerate(model.pieces)}
    if model.kind == pm.UNIGRAM:
        # Control and byte pieces never match a text's own characters: any spelling out is better.
        low = model.min_score - 1e5
        scored = [(p, s if kind in (pm.NORMAL, pm.USER_DEFINED) else low) for p, s, kind in model.pieces]
        core = models.Unigram(scored, unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    elif model.kind == pm.BPE:
        # A piece is merged from every split into two pieces, the pairs in order of the merged piece's score.
        merges = []
        for k, (piece, score, kind) in enumerate(model.pieces):
            if kind == pm.NORMAL:
                pairs = [(piece[:c], piece[c:]) for c in range(1, len(piece)) if piece[:c] in vocab and piece[c:] in vocab]
                merges += [(-score, k, vocab[a], vocab[b], a, b) for a, b in pairs]
        core = models.BPE(
            vocab, [(a, b) for *_, a, b in sorted(merges)], unk_token=model.pieces[model.unk_id][0],
            fuse_unk=True, byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError(f"model kind {model.kind} is neither unigram nor BPE")
    made = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(pm.MARK))
    made.normalizer = normalizers.Sequence(steps)
    # Marks for spaces, without cutting there: cheaper than as a rule of the normaliser, which looks for an expression.
    made.pre_tokenizer = pre_tokenizers.Metaspace(pm.MARK, prepend_scheme="never", split=False)
    made.add_special_tokens([AddedToken(p, special=True, normalized=False) for p, _, kind in model.pieces if kind == pm.CONTROL])
    made.encode_special_tokens = True  # their strings in a text are ordinary text
    return made


class Encoder:
    """Encodes and decodes batches of whole texts by the rebuilt pipeline; with ``parity`` the sentencepiece library encodes them as well."""

    def __init__(self, data: bytes, parity: bool = True) -> None:
        self.model = pm.parse(data)
        self.made, self.reader = rebuild(self.model), rebuild_decoder(self.model)
        self.other = None
        if parity:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_proto=data)

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], bool]]:
        """Ids of each text, and whether sentencepiece gives the same."""
        plain = [t or "" for t in texts]
        ids = [e.ids for e in self.made.encode_batch_fast(plain, add_special_tokens=False)]
        theirs = self.other.encode(plain, num_threads=1) if self.other is not None else ids
        return [(a, a == b) for a, b in zip(ids, theirs, strict=True)]

    def decode(self, batch: list[list[int]]) -> list[str]:
        return self.reader.decode_batch(batch, skip_special_tokens=False)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.Array, list]]:
    """The first column and the values of another in pieces of bounded text: up to ``ROWS`` rows, or about 4 MB."""
    values = batch.column(column)
    lo = size = 0
    for k, n in enumerate(pc.binary_length(values).to_pylist()):
        size += n or 0
        if k + 1 - lo == ROWS or size > 1 << 22 or k + 1 == len(values):
            yield batch.column(0).slice(lo, k + 1 - lo), values.slice(lo, k + 1 - lo).to_pylist()
            lo, size = k + 1, 0


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and where each list begins and ends."""
    bounds = np.cumsum([0, *map(len, lists)])
    return np.fromiter(chain.from_iterable(lists), np.int32, int(bounds[-1])), bounds


def encode_pieces(docs: DataFrame, model_path: str = pm.MODEL_PATH, parity: bool = True, threads: int | None = None) -> DataFrame:
    """doc_id, ids array<int>, parity boolean. The model (of fixed size) travels with the task."""
    data, _ = pm.load(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data, parity, threads)
        for batch in batches:
            for keys, texts in _parts(batch, 1):
                done = encoder.encode(texts)
                ids, bounds = _flat([x for x, _ in done])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys, lists, pa.array([ok for _, ok in done], pa.bool_())], ["doc_id", "ids", "parity"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, parity boolean")


def _encoder(data: bytes, parity: bool, threads: int | None) -> Encoder:
    """An encoder with ``threads`` threads; by default two, or as many as the task has cores (spark.task.cpus)."""
    from pyspark import TaskContext

    context = TaskContext.get()
    threads = threads or max(THREADS, context.cpus() if context else 1)
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    return Encoder(data, parity)


def decode_pieces(encoded: DataFrame, model_path: str = pm.MODEL_PATH, threads: int | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    data, _ = pm.load(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data, False, threads)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = encoder.decode([x or [] for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def encode_summary(docs: DataFrame, model_path: str = pm.MODEL_PATH, threads: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian int32), parity, round_trip (the decoded ids are the text)."""
    data, _ = pm.load(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data, True, threads)
        for batch in batches:
            for keys, texts in _parts(batch, 1):
                done = encoder.encode(texts)
                ids, bounds = _flat([x for x, _ in done])
                back = [a == (b or "") for a, b in zip(encoder.decode([x for x, _ in done]), texts, strict=True)]
                raw = memoryview(ids.astype("<i4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                columns = [keys, pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array([ok for _, ok in done], pa.bool_()), pa.array(back, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"])

    schema = "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean"
    return map_batches(docs.select("doc_id", "text"), run, schema)


def op10_piece_encode(spark, sf_dir):
    return encode_summary(read(spark, sf_dir, "documents"))
