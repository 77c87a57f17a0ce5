"""Whole-text encoding with a tokenizers file through a cache of encoded pieces."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textmill.llm.common import give_back

MOST_CACHED = 600_000  # pieces whose ids are kept; beyond it the half that was used last stays
LEARNED = 16_384  # pieces that are encoded together
# The white space, besides space and line feed, that Unicode knows, in UTF-8.
_OTHER_SPACES = [c.encode() for c in "\t\x0b\x0c\r\x85\xa0                　"]


_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))  # what bytes.split() splits at

# Fixed value: what the lower-casing pre-tokenizer keeps.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ODD, _LETTER, _DIGIT, _SPACE, _LINE, _MARK = range(6)


def _kinds() -> np.ndarray:
    """The kind of each ASCII byte; the apostrophe, at which endings are cut, is odd, as are control characters."""
    kinds = np.full(256, _ODD, np.uint8)
    kinds[33:127] = _MARK
    kinds[[*range(65, 91), *range(97, 123)]] = _LETTER
    kinds[48:58], kinds[32], kinds[10], kinds[39] = _DIGIT, _SPACE, _LINE, _ODD
    return kinds


_KINDS = _kinds()


def _kinds_of(view: np.ndarray) -> np.ndarray:
    """The kind of each byte: both bytes of Latin-1's accented letters are letters, those of all other characters odd."""
    kinds = _KINDS[view]
    leads = np.flatnonzero(view[:-1] == 0xC3)
    second = view[leads + 1]
    leads = leads[(second >= 0x80) & (second < 0xC0) & (second != 0x97) & (second != 0xB7)]
    kinds[leads] = kinds[leads + 1] = _LETTER
    return kinds


def _odd(kinds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the pieces that begin at ``starts`` hold an odd byte, or a line feed after white space."""
    odd = kinds == _ODD
    again = np.flatnonzero(kinds == _LINE)
    again = again[(again > 0) & ((kinds[again - 1] == _LINE) | (kinds[again - 1] == _SPACE))]
    odd[again] = True
    if not odd.any():
        return np.zeros(len(starts), bool)
    return np.logical_or.reduceat(odd, starts)


def _byte_letters() -> np.ndarray:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is visible, else the next from 256. Zero stays, as it parts words here."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters = np.arange(256, dtype="<u4")
    hidden = [b for b in range(256) if b not in shown]
    letters[hidden] = np.arange(256, 256 + len(hidden))
    letters[0] = 0
    return letters


_LETTERS, _ZERO = _byte_letters(), chr(256)
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))


def _numbers(pieces: pa.BinaryArray) -> np.ndarray:
    """A 64-bit number for each piece; equal pieces have the same, and different ones seldom."""
    starts = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    data = np.frombuffer(pieces.buffers()[2], np.uint8)[starts[0] : starts[-1]]
    starts -= starts[0]
    inside = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))
    number = np.add.reduceat((data + np.uint64(1)) * _POWERS[inside % len(_POWERS)], starts[:-1])
    return number ^ (number >> np.uint64(32))


class _Pieces:
    """Ids of known pieces, side by side in Arrow arrays: dictionaries of bytes take several times the memory."""

    def __init__(self, learn: Callable[[pa.BinaryArray], pa.ListArray]) -> None:
        self.learn, self.turn, self.used = learn, 0, np.zeros(0, np.int32)
        self.keys, self.ids = pa.array([], pa.binary()), pa.array([], pa.list_(pa.uint32()))
        self.numbers, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # ascending numbers, and where their pieces are

    def _places(self, pieces: pa.BinaryArray) -> np.ndarray:
        """Where each of these different pieces is; those that are not known are learned."""
        numbers = _numbers(pieces)
        place = np.full(len(pieces), -1, np.int64)
        if len(self.numbers):
            at = np.minimum(np.searchsorted(self.numbers, numbers), len(self.numbers) - 1)
            alike = np.flatnonzero(self.numbers[at] == numbers)
            known = self.places[at[alike]]
            same = pc.equal(self.keys.take(pa.array(known)), pieces.take(pa.array(alike))).to_numpy(zero_copy_only=False)
            place[alike[same]] = known[same]
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = pieces.take(pa.array(missing))
            lists = [self.learn(new[at : at + LEARNED]) for at in range(0, len(new), LEARNED)]
            place[missing] = len(self.keys) + np.arange(len(missing))
            first = np.unique(numbers[missing], return_index=True)[1]
            together = np.concatenate([self.numbers, numbers[missing][first]])
            order = np.argsort(together, kind="stable")
            self.numbers, self.places = together[order], np.concatenate([self.places, place[missing][first].astype(np.int32)])[order]
            self.keys, self.ids = pa.concat_arrays([self.keys, new]), pa.concat_arrays([self.ids, *lists])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int32)])
        return place

    def ids_of(self, pieces: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all pieces, and where those of each begin and the last end."""
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(1, np.int32)
        coded = pieces.dictionary_encode()
        place = self._places(coded.dictionary)
        found = self.ids.take(pa.array(place[coded.indices.to_numpy()]))
        self.turn += 1
        self.used[place] = self.turn
        if len(self.keys) > MOST_CACHED:
            last = np.sort(np.argpartition(self.used, -(MOST_CACHED // 2))[-(MOST_CACHED // 2) :])
            moved = np.full(len(self.keys), -1, np.int32)
            moved[last] = np.arange(len(last))
            self.places = moved[self.places]
            self.numbers, self.places = self.numbers[self.places >= 0], self.places[self.places >= 0]
            self.keys, self.ids, self.used = self.keys.take(pa.array(last)), self.ids.take(pa.array(last)), self.used[last]
        return found.values.to_numpy(), found.offsets.to_numpy()


class PieceEncoder:
    """Gives exactly the ids of ``Tokenizer.encode(text, add_special_tokens=False)``, as little-endian uint32 bytes.

    Neither kind of tokenizer file used here merges across certain white space: byte-level ones cut before a space
    that is alone between two words, lower-casing ones drop ASCII white space. Texts are cut there together, each distinct piece is
    encoded once by the library, and kept ids are joined, all in Arrow and numpy. Texts that hold an added token, or white space for which this
    does not hold, are encoded whole by the library. Pieces of plain letters, digits and ASCII marks, which no normaliser
    but lower-casing changes, are cut further into the pre-tokens of either kind, where the kind of byte changes, and the library's model encodes these. Other
    missing pieces are encoded together, with an added token between them: the library treats what stands between added
    tokens as texts of their own.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.between, self.between_id = spec["added_tokens"][-1]["content"], spec["added_tokens"][-1]["id"]
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        self.drops_spaces = steps[0].get("behavior") == "Removed"
        model = spec["model"]
        usual = model["type"] == "BPE" and not model.get("dropout") and not model.get("unk_token") and not model.get("ignore_merges")
        known = steps[0].get("pattern", {}).get("Regex") == _WORD_PATTERN if self.drops_spaces else steps == [s for s in steps if s.get("use_regex") and not s.get("add_prefix_space")]
        self.zero = [t.id for t in self.tokenizer.model.tokenize(_ZERO)]  # no plain text has it: it stands between pre-tokens
        self.cuts = usual and known and len(self.zero) == 1
        self.model = Tokenizer(self.tokenizer.model)  # takes pre-tokens
        self.cache = _Pieces(self._learn)

    def _together(self, texts: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(texts)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.between_id).tolist()
        if len(cuts) != len(texts) - 1:
            raise ValueError("an added token stands inside a piece")
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True)]

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def can_cut(self, text: bytes) -> bool:
        """Whether the text's pieces, each encoded alone, give its ids."""
        if any(t in text for t in self.added):
            return False
        if self.drops_spaces:
            return True
        if b"  " in text or b"\n \n" in text or text[:1] in b" \n" or text[-1:] in b" \n":
            return False
        return not any(s in text for s in (_OTHER_SPACES[:4] if text.isascii() else _OTHER_SPACES))

    def pieces(self, texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
        """The pieces of texts that are not empty, one after the other, and the number of pieces before each text and after the last.

        Byte-level pieces hold the space before them; the first of a text has none.
        """
        view, begins = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        starts = np.zeros(len(view) + 1, bool)
        if self.drops_spaces:
            kept = ~_BLANK[view]
            starts[1:-1] = ~kept[:-1]
            starts[begins] = True
            starts[:-1] &= kept
            begins = np.concatenate([[0], np.cumsum(kept)])[begins]
            # a blank text's end stays a start only where the next one begins
            view, starts = view[kept], np.append(starts[:-1][kept], True)
        else:
            starts[:-1] = view == 32
            starts[begins] = True
        at = np.flatnonzero(starts)
        if self.cuts and len(view):
            kinds = _kinds_of(view)
            odd = np.repeat(_odd(kinds, at[:-1]), np.diff(at))
            change = kinds[1:] != kinds[:-1]
            if self.drops_spaces:
                change |= kinds[1:] == _DIGIT
                view = np.where((view >= 65) & (view <= 90) & ~odd, view + np.uint8(32), view)
            else:
                change &= kinds[:-1] != _SPACE
            starts[1:-1] |= change & ~odd[1:]
            at = np.flatnonzero(starts)
        pieces = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(view)])
        return pieces, np.searchsorted(at, begins)

    def _learn(self, pieces: pa.BinaryArray) -> pa.ListArray:
        """The ids of different pieces: of plain ones by the model, of others by the whole tokenizer."""
        found = pieces.to_pylist()
        starts = np.cumsum([0, *map(len, found)])
        odd = np.ones(len(found), bool)
        if self.cuts:
            odd = np.array([x[0] == 10 and len(x) > 1 for x in found]) | _odd(_kinds_of(np.frombuffer(b"".join(found), np.uint8)), starts[:-1])
        ids, ends = [], []
        plain = [x for x, o in zip(found, odd.tolist(), strict=True) if not o]
        if plain:
            text = b"\0\0\0".join(plain)
            if self.drops_spaces:
                text = text.decode().lower().encode()
            spelled = _LETTERS[np.frombuffer(text, np.uint8)].tobytes().decode("utf-32-le").replace("\0\0\0", f"\0{_ZERO}\0").split("\0")
            got = np.array(self.model.encode_batch_fast([spelled], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            between = np.flatnonzero(got == self.zero[0])
            if len(between) != len(plain) - 1:
                raise ValueError("a plain text holds the id of byte zero")
            ids.append(got[got != self.zero[0]])
            ends += [*(between - np.arange(len(between))).tolist(), len(ids[0])]
        rest = [x.decode("utf-8", "replace") for x, o in zip(found, odd.tolist(), strict=True) if o]
        for at in range(0, len(rest), 1024):
            for data in self._together(rest[at : at + 1024]):
                ids.append(np.frombuffer(data, "<u4"))
                ends.append((ends[-1] if ends else 0) + len(ids[-1]))
        lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(np.concatenate(ids)))
        place = np.empty(len(found), np.int64)
        place[~odd], place[odd] = np.arange(len(plain)), len(plain) + np.arange(len(rest))
        return lists.take(pa.array(place))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text. The distinct pieces of all texts are looked up once."""
        out: list[bytes] = [b""] * len(texts)
        cut = [i for i, text in enumerate(texts) if text and self.can_cut(text)]
        for i in {i for i, text in enumerate(texts) if text}.difference(cut):
            out[i] = self.whole(texts[i])
        if cut:
            pieces, firsts = self.pieces([texts[i] for i in cut])
            ids, offsets = self.cache.ids_of(pieces)
            data, bounds = ids.astype("<u4", copy=False).tobytes(), (4 * offsets[firsts]).tolist()
            for i, a, b in zip(cut, bounds[:-1], bounds[1:], strict=True):
                out[i] = data[a:b]
            del pieces, ids, data
            give_back()
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
