"""Token counts as a tokenizer library gives them, with bounded memory for texts of any length.

A huge document is encoded in chunks that overlap. Two neighbouring chunks are spliced at a boundary that both
have and that is proven stable: a word or the blank before it begins there, and on either side of it both encodings have the same
``AGREE`` tokens at the same offsets (all there are between it and the document's end). Where the overlap
holds no such boundary, it is widened and encoded again, at last to the rest of the document.

For a tokenizer that drops blanks before it looks for tokens, any blank is a stable boundary, so the words of
ordinary documents are counted by the library once each and remembered; for others the whole text is
encoded.

Defined cases: null and empty texts have 0 tokens; special tokens inside texts are handled as the library
does by default; repeated rows count alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import bounded_batches, named

#: Characters from which on a document is encoded in chunks, and of a chunk.
HUGE = 1 << 15
CHUNK = 1 << 14
OVERLAP = 256
AGREE = 6
#: Words a worker remembers.
MEMORY = 500_000
LIMIT_TOKENS = 2048


class TokenCounter:
    """Counts tokens of one vocabulary file: ``.json`` by tokenizers, ``.model`` by sentencepiece."""

    def __init__(self, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.huge, self.chunk, self.overlap = huge, chunk, overlap
        self.known: dict[str, int] = {}
        self.widened = 0
        self.pieces = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.by_word = False
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.by_word = drops_blanks(path)

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, id) of the tokens, in characters of the text."""
        if self.pieces is not None:
            found = self.pieces.encode(text, return_type="proto").pieces
            return [(p.begin, p.end, p.id) for p in found]
        e = self.library.encode(text, add_special_tokens=False)
        return [(a, b, i) for (a, b), i in zip(e.offsets, e.ids)]

    def count(self, text: str | None) -> int:
        return self.count_all([text])[0]

    def count_all(self, texts: list[str | None]) -> list[int]:
        if not self.by_word:
            return [0 if not t else self.count_chunks(t) if len(t) >= self.huge else len(self.encode(t)) for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        short = [None if not t or len(t) >= self.huge else t.replace("\n", " ").split(" ") for t in texts]
        new = list(set().union(*(w for w in short if w)) - self.known.keys())
        for k in range(0, len(new), 10_000):
            part = new[k:k + 10_000]
            self.known.update(zip(part, map(len, self.library.encode_batch_fast(part, add_special_tokens=False))))
        get = self.known.__getitem__
        return [sum(map(get, w)) if w else self.count_chunks(t) if t else 0 for w, t in zip(short, texts)]

    def count_chunks(self, text: str) -> int:
        """Tokens of a long text by overlapping chunks."""
        total, begin, skip = 0, 0, 0  # skip: tokens of the chunk at ``begin`` that lie before the splice
        end = min(len(text), self.chunk)
        tokens = self.encode(text[begin:end])
        while end < len(text):
            overlap = self.overlap
            while True:
                start = max(begin + 1, end - overlap)
                # a chunk begins at a blank or the document's start only by chance: its first tokens may differ
                after = min(len(text), start + self.chunk + overlap)
                following = self.encode(text[start:after])
                cut = splice(text, [(a + begin, b + begin, i) for a, b, i in tokens[skip:]],
                             [(a + start, b + start, i) for a, b, i in following], start, end, after == len(text))
                if cut is not None:
                    total += cut[0]
                    begin, end, tokens, skip = start, after, following, cut[1]
                    break
                self.widened += 1
                overlap *= 2
                if end - overlap <= begin:  # nothing left to widen to: twice the chunk, so all work stays in proportion
                    end = min(len(text), 2 * end - begin)
                    tokens = self.encode(text[begin:end])
                    if end == len(text):
                        break
                    overlap = self.overlap
        return total + len(tokens) - skip


def splice(text: str, left: list, right: list, start: int, end: int, last: bool) -> tuple[int, int] | None:
    """(tokens of ``left`` before the boundary, tokens of ``right`` before it), or None.

    The boundary lies at the beginning of a word or of the blank before it, within [start, end), as near as possible to the middle.
    """
    first = next((k for k, t in enumerate(left) if t[0] >= start), len(left))
    at = {t: k for k, t in reversed(list(enumerate(right)))}
    middle, found = (start + end) // 2, []
    for i in range(first + AGREE, len(left) - AGREE + 1):
        p = left[i][0] if i < len(left) else end
        j = at.get(left[i]) if i < len(left) else None
        if j is not None and j >= AGREE and (text[p - 1:p].isspace() or text[p:p + 1].isspace()) and left[i - AGREE:i + AGREE] == right[j - AGREE:j + AGREE]:
            found.append((abs(p - middle), i, j))
    return min(found)[1:] if found else None


def drops_blanks(path: str) -> bool:
    """Whether the tokenizer removes blanks and newlines before it looks for tokens, so none spans them."""
    import re

    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    pre = parts.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0] if steps else {}
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    pattern = first["pattern"].get("Regex", "").replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9")
    try:
        found = re.compile(pattern)
    except re.error:
        return False
    texts = ("a b", "1 2", "! !", "a\nb", " ", "\n", "'s 's", "a  b")
    return not any(" " in m.group() or "\n" in m.group() for t in texts for m in found.finditer(t))


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter for each worker and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text",
                 limit: int = LIMIT_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document. ``path``: the vocabulary file on every machine."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(named(doc_id).alias("doc_id"), F.coalesce(named(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            n = pa.array(own.count_all(b.column(1).to_pylist()), pa.int64())
            size = pa.compute.binary_length(b.column(1).cast(pa.binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n], names=["doc_id", "n_bytes", "n_tokens"])

    id_type = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)
