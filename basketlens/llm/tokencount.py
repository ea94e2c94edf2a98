"""Token counts by a tokenizer library, without keeping the tokens.

The library runs inside Arrow functions where the texts are read; only lengths come back. The tokenizer
of a ``.json`` file with a white-space-dropping pre-tokenizer treats each run of other characters by
itself, so white space is a safe boundary: texts, long ones too, are split there, and each distinct
run of a batch is encoded once, in calls of about the same number of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.memo import Memo
from basketlens.llm.words import Texts, pieces

#: Bytes of text split at once, bytes handed to the library at once, words remembered by a worker.
PIECE = 1 << 22
CALL = 1 << 16
REMEMBERED = 400_000
#: Longer words are not remembered.
LONGEST = 64


class Counter:
    """Numbers of tokens of words; made anew in each Python worker."""

    def __init__(self, path: str, model: bytes):
        self.memo = Memo(REMEMBERED)
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_proto=model)
            self.split = False
            self.lengths = lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
        else:
            import os

            # One thread: Spark runs a task on each core.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_buffer(model)
            tokenizer.no_padding()
            tokenizer.no_truncation()
            # Byte-level tokenizers that keep white space have it inside their tokens.
            self.split = self._drops_space(tokenizer)
            self.lengths = lambda texts: [
                len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ]

    @staticmethod
    def _drops_space(tokenizer) -> bool:
        def n(text: str) -> int:
            return len(tokenizer.encode(text, add_special_tokens=False))

        return n(" \n\t") == 0 and n("ab ab\nab") == 3 * n("ab")

    def counted(self, words: list[str]) -> np.ndarray:
        """Tokens of each word."""
        out = np.zeros(len(words), dtype=np.int64)
        new: list[int] = []
        size = 0
        for i, word in enumerate(words):
            n = self.memo.get(word)
            if n is not None:
                out[i] = n
                continue
            new.append(i)
            size += len(word)
            if size >= CALL:
                self._count(words, new, out)
                new, size = [], 0
        self._count(words, new, out)
        return out

    def _count(self, words: list[str], new: list[int], out: np.ndarray) -> None:
        if new:
            for i, n in zip(new, self.lengths([words[i] for i in new]), strict=True):
                out[i] = n
                if len(words[i]) <= LONGEST:
                    self.memo.put(words[i], n)

    def tokens(self, texts: Texts) -> np.ndarray:
        """Tokens of each text."""
        if not self.split:
            return self.counted([texts.text(i).decode() for i in range(len(texts))])
        # Words and the gaps between them lie side by side; every second value is a word.
        edges = np.empty(2 * len(texts.starts) + 1, dtype=np.int64)
        edges[0:-1:2], edges[1::2], edges[-1] = texts.starts, texts.ends, len(texts.data)
        column = pa.LargeStringArray.from_buffers(
            len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(texts.data)
        )
        coded = column.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode()
        counts = self.counted(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sums = np.concatenate(([0], np.cumsum(counts)))
        return sums[texts.of_text[1:]] - sums[texts.of_text[:-1]]


_counters: dict[tuple[str, int], Counter] = {}


def token_counts(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every text, by the library for the vocabulary file ``path``.

    No begin, end or added special tokens; special strings inside a text are what the library makes of
    them by default. A null text counts as empty: zero bytes, zero tokens. Each row is counted by
    itself; repeated rows and ids, also null ones, stay. Other columns are not read. The driver reads the file and hands
    its bytes, a few megabytes whatever the corpus, to the executors.
    """
    frame = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    with open(path, "rb") as file:
        model = documents.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, len(model.value))
        counter = _counters.get(key)
        if counter is None:
            counter = _counters[key] = Counter(path, model.value)
        for batch in batches:
            for texts in pieces(batch["text"], PIECE):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(texts.first, len(texts)),
                        pa.array(np.diff(texts.offsets)),
                        pa.array(counter.tokens(texts)),
                    ],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    return frame.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
