"""Ids of whole texts from a public tokenizer file.

The pre-tokenizers of the files used here never join what stands before a single space or line
feed between two other characters with what stands after it.  Texts are therefore cut at these
places, and the ids of a segment are looked up by the segment once the tokenizers library has
encoded it; segments repeat, as words do.  The ids of the segments, one after the other, are those
of the whole text.  Where lines hold words with single spaces between them, plain splitting gives the segments; other texts are
searched for them.

Most new segments are a word of Latin letters with punctuation after it or none.  Where the file's normalizer and pre-tokenizer are
those of ``_PLAIN``, it is known that they make just these two pieces of it.  The new words are then encoded many in one call, and
the ids are told apart by the tokens that begin or end a word; other segments, and those of other files, are encoded one by one.

Texts that hold the string of an added token, such as ``<|endoftext|>``, in whatever case are encoded whole by the library, which
gives these strings their own ids.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark shares out the work
from tokenizers import Tokenizer  # noqa: E402

CACHED = 500_000  # segments whose ids a worker remembers
LONG = 100  # characters of a segment that is not remembered
GROUP = 50_000  # segments that are looked up together
TOGETHER = 1_000  # new words that the library encodes in one call
# a segment ends before a single space or line feed between two other characters, and nowhere else
_SEGMENT = re.compile(r"\s*+\S++(?:(?:\s\s++|[^\S \n])\S++)*+(?:\s++\Z)?+|\s++")
# a word of letters that no normalizer of _PLAIN composes with others, after a space, a line feed or nothing, and ASCII punctuation
_WORD = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿŒœ]++)([!-/:-@\[-`{-~]*+)")
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# normalizer and pre-tokenizer of a file, and what they make of a word before its bytes are spelled
_PLAIN: list[tuple[dict | None, dict, Callable[[str], str]]] = [
    (None, {**_BYTE_LEVEL, "use_regex": True}, str),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {**_BYTE_LEVEL, "use_regex": False}]},
        lambda word: word.strip(" \n").lower(),
    ),
]


def _spelling() -> dict[int, str]:
    """The character by which byte-level files write each byte: itself where it prints, else one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in prints)
    return {**{b: chr(b) for b in prints}, **{b: chr(256 + k) for k, b in enumerate(others)}}


_SPELLED = _spelling()
_open: dict[int, Encoder] = {}


def _key(segment: str) -> str:
    """The name under which a segment is remembered: what follows its single space, else a carriage return and the whole."""
    return segment[1:] if segment[0] == " " and not segment[1:2].isspace() and len(segment) > 1 else "\r" + segment


def _segment(key: str) -> str:
    return key[1:] if key[0] == "\r" else " " + key


def _keys(text: str) -> list[str]:
    """The names of a text's segments."""
    out: list[str] = []
    lead = "\r"
    for line in text.split("\n"):
        words = line.split()
        if not words or " ".join(words) != line:
            return [_key(x) for x in _SEGMENT.findall(text)]
        words[0] = lead + words[0]
        out += words
        lead = "\r\n"
    return out


class Encoder:
    def __init__(self, spec: str, end_id: int | None):
        self.tokenizer = Tokenizer.from_str(spec)
        self.added = [t.content.casefold() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        self.model = self.tokenizer.model
        self.plain = self._plain()
        self.known: dict[str, bytes] = {}  # those asked for lately
        self.before: dict[str, bytes] = {}  # those before them
        self.marks: dict[str, bytes] = {"": b""}  # of up to three characters
        self.bounds, self.begins = self._bounds()

    def _plain(self) -> Callable[[str], str] | None:
        """How a word reaches the model, if that is known of this file."""
        state = lambda part: None if part is None else json.loads(part.__getstate__())
        made = state(self.tokenizer.normalizer), state(self.tokenizer.pre_tokenizer)
        if type(self.model).__name__ != "BPE" or self.model.dropout:
            return None
        return next((how for normalizer, pieces, how in _PLAIN if made == (normalizer, pieces)), None)

    def _piece(self, piece: str) -> bytes:
        """Ids of a word, of punctuation or of a line feed before a word, which the pre-tokenizer leaves whole."""
        word = self.plain(piece)
        spelled = word.encode().decode("latin-1").translate(_SPELLED)
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _bounds(self) -> tuple[np.ndarray, bool]:
        """By id, whether its token ends a word, or begins one where the file does not mark ends."""
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.model, "end_of_word_suffix", None)
        out = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        for token, n in vocabulary.items():
            out[n] = token.endswith(suffix) if suffix else token.startswith(_SPELLED[32])
        return out, not suffix

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of different words of Latin letters, each after a space."""
        out: dict[str, bytes] = {}
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            places = np.flatnonzero(self.bounds[ids])
            if len(places) == len(some):
                raw = ids.tobytes()
                cuts = (4 * places).tolist() if self.begins else [0, *(4 * places + 4).tolist()]
                out.update(zip(some, (raw[b:e] for b, e in zip(cuts, [*cuts[1:], len(raw)])), strict=False))
            else:
                out.update((w, self._whole(" " + w)) for w in some)
        return out

    def _learn(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of new segments by their names."""
        out: dict[str, bytes] = {}
        made: list[tuple[str, str, str]] = []  # name, its word where that is another name, punctuation
        words: list[str] = []
        known, before, plain = self.known, self.before, self.plain
        drops = plain is not None and plain("\n") == ""  # the file drops what stands before a word
        for key in keys:
            if (ids := before.get(key)) is not None:
                out[key] = ids
                continue
            word, marks = key, ""
            if not plain or not (key.isascii() and key.isalpha()):
                if not plain or not (m := _WORD.fullmatch(_segment(key))):
                    out[key] = self._whole(_segment(key))
                    continue
                lead, word, marks = m.groups()
                if lead != " " and not drops:
                    out[key] = self._mark(lead) + self._piece(word) + self._mark(marks)
                    continue
            word = plain(word)
            words.append(word)
            if word != key:
                made.append((key, word, marks))
        new = [w for w in dict.fromkeys(words) if w not in out and w not in known]
        out.update((w, before[w]) for w in new if w in before)
        out.update(self._words([w for w in new if w not in out]))
        out.update((key, (out.get(word) or known[word]) + self._mark(marks)) for key, word, marks in made)
        return out

    def _mark(self, marks: str) -> bytes:
        if marks in self.marks:
            return self.marks[marks]
        ids = self._piece(marks)
        if len(marks) <= 3:
            self.marks[marks] = ids
        return ids

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text and the end id; null counts as empty."""
        waiting: list[str] = []
        ends: list[int] = []
        for text in texts:
            if text and any(a in folded for folded in (text.casefold(),) for a in self.added):
                yield from self._encoded(waiting, ends)
                waiting, ends = [], []
                yield self._whole(text) + self.end
                continue
            if text:
                waiting += _keys(text)
            ends.append(len(waiting))
            if len(waiting) >= GROUP:
                yield from self._encoded(waiting, ends)
                waiting, ends = [], []
        yield from self._encoded(waiting, ends)

    def _encoded(self, keys: list[str], ends: list[int]) -> Iterator[bytes]:
        """Ids of texts, whose segments stand one after the other in ``keys`` up to ``ends``."""
        found = list(map(self.known.get, keys))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = self._learn(list(dict.fromkeys(keys[i] for i in missing)))
        for i in missing:
            found[i] = new[keys[i]]
        if len(self.known) + len(new) > CACHED // 2:
            self.before, self.known = self.known, {}
        self.known.update((k, ids) for k, ids in new.items() if len(k) <= LONG)
        begin = 0
        for end in ends:
            yield b"".join(found[begin:end]) + self.end
            begin = end


def encoder(spec: str, end_id: int | None) -> Encoder:
    """The encoder of a tokenizer file's content; a worker keeps it for its later tasks."""
    key = hash((spec, end_id))
    if key not in _open:
        _open.clear()
        _open[key] = Encoder(spec, end_id)
    return _open[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
