"""Token counts by overlap resynchronisation.

Documents longer than ``CHUNK`` characters are encoded in overlapping chunks.
Token offsets of two neighbouring chunks are compared in their overlap and the
encodings are spliced at a token boundary that both have and that the coder
proves stable: the text on either side is tokenised alike whatever surrounds it.
Where an overlap has no such boundary it is doubled, up to the whole document;
a coder without a proof encodes whole texts.

The place between a character that isn't white space and a plain space (or line
feed) is stable if nothing spans it: no branch of the pre-tokeniser's pattern
and no special token (``.json`` files with one of the two patterns below), or
no piece of the vocabulary (``.model`` files that keep texts as they are)."""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapewright.llm.common import each

CHUNK = 1 << 16
OVERLAP = 1 << 10


def before_space(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] in " \n" and not text[at - 1].isspace()


class HuggingFace:
    """Any ``.json`` file, by the tokenizers library."""

    def __init__(self, path: str, spec: dict | None = None):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.stable = before_space if spec is not None and splits_at_spaces(spec) else None

    def ids(self, text: str):
        import numpy as np

        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def offsets(self, text: str):
        """ids, and the character after each token's last one."""
        import numpy as np

        got = self.model.encode(text, add_special_tokens=False)
        return np.array(got.ids, dtype=np.uint32), np.array([e for _, e in got.offsets], dtype=np.int64)


class ByteLevel:
    """A byte-level BPE ``.json`` whose ids are its merge ranks: the same ids as
    the tokenizers library gives, from its own vocabulary, by tiktoken (about
    four times as fast). Special strings in a text become their ids, as is that
    library's default."""

    stable = staticmethod(before_space)

    def __init__(self, path: str, spec: dict):
        import numpy as np
        import regex
        import tiktoken

        self.library = functools.lru_cache(1)(functools.partial(HuggingFace, path))
        specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {unspell(k): v for k, v in spec["model"]["vocab"].items() if k not in specials}
        self.model = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.specials = specials
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.width = np.zeros(max([*ranks.values(), *specials.values()]) + 1, dtype=np.int64)
        for k, v in ranks.items():
            self.width[v] = len(k)
        for k, v in specials.items():
            self.width[v] = len(k.encode())

    def plain(self, text: str):
        import numpy as np

        try:
            return np.array(self.model.encode_ordinary(text), dtype=np.uint32)
        except Exception:
            raise
        except BaseException as e:  # a Rust panic on very long unbroken pieces
            if type(e).__name__ != "PanicException":
                raise
            return self.library().ids(text)

    def ids(self, text: str):
        import numpy as np

        if self.split is None or not any(s in text for s in self.specials):
            return self.plain(text)
        parts = [np.array([self.specials[x]], dtype=np.uint32) if i % 2 else self.plain(x) for i, x in enumerate(self.split.split(text))]
        return np.concatenate(parts)

    def offsets(self, text: str):
        """ids, and the character after each token's last one (-1 inside a character)."""
        import numpy as np

        ids = self.ids(text)
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        starts = (raw & 0xC0) != 0x80
        char = np.full(len(raw) + 1, -1, dtype=np.int64)
        char[np.flatnonzero(starts)] = np.arange(int(starts.sum()))
        char[len(raw)] = len(text)
        return ids, char[np.cumsum(self.width[ids])]


# The pre-tokenisers' patterns of byte-level files and of files with word ends.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_spaces(spec: dict) -> bool:
    """Whether nothing in a ``.json`` file spans a place before a space: neither
    its normaliser (characters and runs of white space alone), its pattern, nor
    its added tokens."""
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = normal.get("normalizers", [normal] if normal else [])
    plain = all(x.get("type") in ("NFC", "Lowercase") or (x.get("type"), x.get("pattern"), x.get("content")) == ("Replace", {"Regex": r"\s+"}, " ") for x in steps)
    added = any(any(c.isspace() for c in x["content"]) or x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec["added_tokens"])
    parts = pre.get("pretokenizers", [pre])
    bytes_ = parts[-1].get("type") == "ByteLevel" and not parts[-1].get("add_prefix_space")
    if len(parts) == 1:
        split = parts[0].get("use_regex", True)
    else:
        split = len(parts) == 2 and not parts[1].get("use_regex", True) and (parts[0].get("type"), parts[0].get("pattern"), parts[0].get("behavior"), parts[0].get("invert")) == ("Split", {"Regex": WORDS}, "Removed", True)
    return bool(plain and not added and bytes_ and split and not spec.get("post_processor") and spec["model"].get("type") == "BPE")


@functools.lru_cache(1)
def _bytes() -> dict[str, int]:
    """Byte-level BPE spells bytes as printable characters: printable Latin-1 as
    itself, the others as the characters from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in keep}, 0
    for b in range(256):
        if b not in keep:
            out[chr(256 + n)] = b
            n += 1
    return out


def unspell(token: str) -> bytes:
    return bytes(_bytes()[c] for c in token)


class Pieces:
    """A ``.model`` file, by the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = next((dict(_fields(v)) for f, v in _fields(self.model.serialized_model_proto()) if f == 3), {})
        kept = normal.get(1) == b"identity" and not normal.get(2) and not normal.get(4, 1)  # name, table, whether spaces are removed
        inner = any("\u2581" in self.model.id_to_piece(i).lstrip("\u2581") for i in range(self.model.get_piece_size()))
        self.stable = self._before_space if kept and not inner else None

    @staticmethod
    def _before_space(text: str, at: int) -> bool:
        return 0 < at < len(text) and text[at] == " " and not text[at - 1].isspace() and text[at - 1] != "\u2581"

    def ids(self, text: str):
        import numpy as np

        return np.array(self.model.encode(text), dtype=np.uint32)

    def offsets(self, text: str):
        """ids, and the character after each token's last one."""
        import numpy as np

        got = self.model.encode(text, return_type="offset_mapping")
        return np.array(got["ids"], dtype=np.uint32), np.array([e for _, e in got["offsets"]], dtype=np.int64)


def _fields(raw: bytes):
    """(number, value) of the fields of a protobuf message."""
    at = 0

    def number():
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        n = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, raw[at : at + n]
        at += n


@functools.lru_cache(4)
def load(path: str):
    """The encoder for a vocabulary file: kept by each Python worker."""
    if path.endswith(".model"):
        return Pieces(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not any(spec.get(k) for k in ("normalizer", "post_processor"))
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not any(x.get(k) for x in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
    )
    if plain:
        merged = ["".join(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
        order = [model["vocab"].get(x) for x in merged]
        if None not in order and order == sorted(order):
            return ByteLevel(path, spec)
    return HuggingFace(path, spec)


def encode_long(coder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """The ids of a text of any length; the same as ``coder.ids(text)``."""
    import numpy as np

    if len(text) <= chunk or coder.stable is None:
        return coder.ids(text)
    out, done, lap = [], 0, overlap  # done: the text before it is spliced
    start, end = 0, min(chunk, len(text))  # of the chunk in ids, ends
    ids, ends = coder.offsets(text[:end])
    while end < len(text):
        lap = min(max(lap, 1), end - done)
        nxt_start, nxt_end = end - lap, min(len(text), end + chunk)
        nids, nends = coder.offsets(text[nxt_start:nxt_end])
        left = ends[ends > 0] + start
        left = left[(left > nxt_start) & (left < end)]
        right = nends[nends > 0] + nxt_start
        common = np.intersect1d(left, right)
        cut = next((int(p) for p in common[::-1] if p > done and coder.stable(text, int(p))), None)
        if cut is None:
            if nxt_start <= done:  # even the whole chunk has no stable boundary: make it longer
                end = min(len(text), done + 2 * (end - done))
                ids, ends = coder.offsets(text[start:end])
                lap = overlap
            else:
                lap *= 2
            continue
        out.append(_between(ids, ends, done - start, cut - start))
        ids, ends, start, end, done, lap = nids, nends, nxt_start, nxt_end, cut, overlap
    out.append(_between(ids, ends, done - start, None))
    return np.concatenate(out)


def _between(ids, ends, lo: int, hi: int | None):
    """The ids after the last token that ends at ``lo`` (0: from the first on), up
    to the last one that ends at ``hi`` (None: to the end)."""
    import numpy as np

    first = int(np.flatnonzero(ends == lo)[-1]) + 1 if lo > 0 else 0
    return ids[first:] if hi is None else ids[first : int(np.flatnonzero(ends == hi)[-1]) + 1]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    Null text counts as empty (0 bytes, 0 tokens). Rows are independent: null
    or repeated ids give a row each; other columns are not read. An empty table
    gives an empty result. Very long texts are encoded chunk by chunk."""

    def run(batches):
        import pyarrow as pa

        coder = load(path)
        for batch in batches:
            n, size = [], []
            for text in each(batch.column(1)):
                n.append(len(encode_long(coder, text)) if text else 0)
                size.append(len(text.encode()) if text else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
