"""Whole-text token ids from a public tokenizer file, an Arrow batch at a time.

The pre-tokenizer of a byte-level BPE never lets a piece cross the point before
a single space between two inked characters, either side of a single newline
between them, or the point between a letter or digit and a full stop or comma.
A batch is cut at those points, every distinct cut is encoded once by the
``tokenizers`` library, and the ids of a text are the joined ids of its cuts.
Texts in which a space touches other white space, or that have the string of an
added token (which the library finds before anything else), are encoded whole,
and so is every text where the tokenizer isn't such a byte-level BPE. So the ids
are those of the library's own ``encode`` on the whole text.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lakeweave.llm.workers import worker_state

#: white space as the tokenizer's pre-tokenizer sees it
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_INK = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}\x00]"
#: texts that are encoded whole: a space beside other white space, or the cut mark itself
_WHOLE = f" {_SPACE}|{_SPACE} |\x00"
_CUT = "\x00"
#: how byte-level tokenizers write bytes as characters: printable Latin-1 as itself, the rest from U+0100 on
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def vocabulary_size(tokenizer_path: str) -> int:
    """Ids that the tokenizer may give, special tokens included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)


def cuts_are_safe(tokenizer) -> bool:
    """Whether the tokenizer is a plain byte-level BPE, for which the cuts are proven: no normalizer, the pre-tokenizer's
    own pattern, no space put before the text, nothing cut off or padded, and no part of the model that looks beyond a piece."""
    told = json.loads(tokenizer.to_str())
    pre, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    bpe = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    return plain and bpe and not any(told.get(k) for k in ("normalizer", "truncation", "padding"))


def _quoted(text: str) -> str:
    """A regular expression for the text itself."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


class TextEncoder:
    """Encodes Arrow string arrays; ``cuts`` bounds the cuts remembered between batches."""

    def __init__(self, tokenizer_path: str, cuts: int = 1_000_000, batch_bytes: int = 12_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.may_cut = cuts_are_safe(self.tokenizer)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.whole = "|".join([_WHOLE, *map(_quoted, added)])
        self.cuts, self.batch_bytes = cuts, batch_bytes
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def shared(cls, tokenizer_path: str) -> TextEncoder:
        """The worker's own encoder for this file, kept from task to task, until a task that doesn't tokenize (``lean``)."""
        kept = worker_state().__dict__.setdefault("encoders", {})
        if tokenizer_path not in kept:
            kept[tokenizer_path] = cls(tokenizer_path)
        return kept[tokenizer_path]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        out: list[bytes] = []
        at = 0
        while at < len(texts):  # pieces of bounded size, so that a batch of very long texts stays small
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self.batch_bytes, "right")))
            out += self._encode(texts.slice(at, to - at))
            at = to
        return out

    def _encode(self, texts: pa.Array) -> list[bytes]:
        if not self.may_cut:
            found = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return [np.array(e.ids, dtype="<u4").tobytes() for e in found]
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        marked = pc.replace_substring(pc.if_else(pa.array(whole), "", texts), " ", _CUT + " ")
        marked = pc.replace_substring_regex(marked, r"([\p{L}\p{N}])([.,])", f"\\1{_CUT}\\2")
        marked = pc.replace_substring_regex(marked, rf"({_INK})\n({_INK})", f"\\1{_CUT}\n{_CUT}\\2")
        cut = pc.split_pattern(marked, _CUT)
        offsets = cut.offsets.to_numpy().astype(np.int64)
        table = pc.dictionary_encode(cut.flatten())
        ids = pa.array(self._known(table.dictionary.to_pylist()), pa.large_binary())
        joined = ids.take(table.indices)
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)
        data = memoryview(joined.buffers()[2] or b"")
        at = ends[offsets - offsets[0]].tolist()
        out = [bytes(data[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        if whole.any():
            where = np.flatnonzero(whole).tolist()
            found = self.tokenizer.encode_batch_fast([texts[i].as_py() for i in where], add_special_tokens=False)
            for i, e in zip(where, found, strict=True):
                out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def _known(self, cuts: list[str]) -> list[bytes]:
        recent, older, out, missing = self.recent, self.older, [], []
        for i, c in enumerate(cuts):
            got = recent.get(c)
            if got is None:
                got = older.get(c)
                if got is None:
                    missing.append(i)
                else:
                    recent[c] = got
            out.append(got)
        tokenize = self.tokenizer.model.tokenize
        rest = []
        for i in missing:
            c = cuts[i]
            if (c[1:] if c[:1] == " " else c).isalpha() and max(c) < "\u0530":  # one piece: straight to the model
                found = tokenize(c.encode().decode("latin-1").translate(_LETTER))
                recent[c] = out[i] = struct.pack(f"<{len(found)}I", *[t.id for t in found])
            else:
                rest.append(i)
        for a in range(0, len(rest), 4096):
            part = rest[a : a + 4096]
            found = self.tokenizer.encode_batch_fast([cuts[i] for i in part], add_special_tokens=False)
            for i, e in zip(part, found, strict=True):
                recent[cuts[i]] = out[i] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        if len(recent) > self.cuts // 2:
            self.recent, self.older = {}, recent
        return out
