"""Token ids of whole texts with the tokenizers library, at the speed of a word memo.

Both public BPE tokenizers split a text into pre-tokens that never cross the borders used here, so the ids of a text
are the ids of its units one after the other. Units repeat far more often than texts do: each worker encodes a unit
once and then joins stored ids. A text with one of the separators U+001C to U+001F, on which Python and the library
disagree about white space, goes to the library whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Memo, coded, holds, only, quiet_tokenizers, spread, tokenizer_file, uncollected

#: A run of Latin letters before ASCII punctuation, white space or the end is a unit of its own: it recurs more often.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\\s!-/:-@\\[-`{-~]|$)"
_BYTE_UNITS = re.compile(f" ?{_LETTERS}| ?\\S+|\\s+(?!\\S)|\\s+")
_WORD_UNITS = re.compile(f"{_LETTERS}|\\S+")
_LATIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Units in one call of the library; lines of some ten thousand characters are encoded fastest.
LINE = 2000
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_HELD: dict[tuple[str, str], Encoder] = {}
holds("encode", _HELD.clear)


class Encoder:
    """name: byte_bpe_50k.json or word_bpe_49k.json; path: another place of that file."""

    def __init__(self, name: str, path: str | None = None):
        quiet_tokenizers()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file(name, path))
        self.tokenizer.encode_special_tokens = True
        self.words = name.startswith("word")
        self.mark = "\x01" if self.words else "\n"
        self.mark_text = " \x01 " if self.words else "\n"
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.plain = Tokenizer.from_file(tokenizer_file(name, path))
        self.plain.encode_special_tokens = True
        if self.words:
            self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=not self.words, use_regex=False)])
        edge = [t.endswith("</w>") if self.words else t.startswith("\u0120") for t in map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))]
        self.edge = np.array(edge)
        self.memo = Memo(self._encode, most=400_000)

    @staticmethod
    def held(name: str, path: str | None = None) -> Encoder:
        only("encode")
        if (name, path or "") not in _HELD:
            _HELD[name, path or ""] = Encoder(name, path)
        return _HELD[name, path or ""]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, units: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(units)
        letters = [i for i, u in enumerate(units) if _LATIN.fullmatch(u) and (self.words or u[0] == " ")]
        self._lines(units, letters, out)
        self._marked(units, sorted(set(range(len(units))).difference(letters)), out)
        return out

    def _lines(self, units: list[str], chosen: list[int], out: list[bytes]) -> None:
        """Latin words are pre-tokens of their own: they go to the library's model in long lines, past its pattern, and
        the ids are cut where a token ends a word (or, with byte-level tokens, begins with a space)."""
        for at in range(0, len(chosen), LINE):
            own = chosen[at : at + LINE]
            flat = np.array(self.plain.encode("".join([units[i] for i in own]) if not self.words else " ".join([units[i] for i in own]).lower(), add_special_tokens=False).ids, "<u4")
            cuts = 4 * np.flatnonzero(self.edge[flat])
            cuts = [0, *(cuts + 4).tolist()] if self.words else [*cuts.tolist(), 4 * len(flat)]
            if len(cuts) != len(own) + 1:
                raise AssertionError("a word must have one edge")
            data = flat.tobytes()
            for i, a, b in zip(own, cuts[:-1], cuts[1:], strict=True):
                out[i] = data[a:b]

    def _marked(self, units: list[str], chosen: list[int], out: list[bytes]) -> None:
        """Other units without white space (but for one leading space) go in lines with a mark between that is always a
        token of its own, and the ids are cut at the marks; the rest one by one."""
        plain = [i for i in chosen if self.mark not in units[i] and not units[i].isspace()]
        for at in range(0, len(plain), LINE):
            own = plain[at : at + LINE]
            flat = np.array(self.tokenizer.encode(self.mark_text.join([units[i] for i in own]), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(flat == self.mark_id)
            if len(cuts) != len(own) - 1:
                raise AssertionError("marks and units must alternate")
            data = flat.tobytes()
            for i, a, b in zip(own, [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(data)], strict=True):
                out[i] = data[a:b]
        rest = sorted(set(chosen).difference(plain))
        for i, ids in zip(rest, self._whole([units[i] for i in rest]), strict=True):
            out[i] = ids

    def _fine(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces between spaces: cut finer, so that a new piece mostly consists of known units."""
        lead = "" if self.words else " "
        whole = [p.isalpha() for p in pieces]  # letters alone are one unit
        simple = [lead + p for p, w in zip(pieces, whole, strict=True) if w]
        own = list(map((_WORD_UNITS if self.words else _BYTE_UNITS).findall, [lead + p for p, w in zip(pieces, whole, strict=True) if not w]))
        units = list(set().union(*own))
        values = self.memo.values(simple + units)
        get = dict(zip(units, values[len(simple) :], strict=True)).__getitem__
        one, more = iter(values), iter(own)
        return [next(one) if w else b"".join(map(get, next(more))) for w in whole]

    @uncollected()
    def flat(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, one after the other, and how many each has."""
        pieces = pc.utf8_split_whitespace(texts) if self.words else pc.split_pattern(texts, " ")
        codes, ends, distinct = coded(pieces)
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)
        if not self.words:
            # a space stands alone between two pieces only if neither is empty nor has white space at that side
            words = pa.array(distinct, pa.string())
            plain = pc.and_(pc.equal(words, pc.utf8_trim_whitespace(words)), pc.not_equal(words, "")).to_numpy(zero_copy_only=False)
            regular = plain[codes]
            first = np.concatenate([[0], ends[:-1]])
            odd |= np.add.reduceat(~regular, first) > 0
        special = {}
        for i in np.flatnonzero(odd).tolist():
            special[i] = self.ids([texts[i].as_py()])[0]
        parts = self._fine(distinct)
        if not self.words:  # the first piece of a text has no space before it
            own = [[] if odd[i] else _BYTE_UNITS.findall(distinct[c]) for i, c in enumerate(codes[first].tolist())]
            units = list(set().union(*own))
            get = dict(zip(units, self.memo.values(units), strict=True)).__getitem__
            parts = [*parts, *[b"".join(map(get, u)) for u in own]]
            codes = codes.copy()
            codes[first] = len(distinct) + np.arange(len(texts))
        parts = [*parts, np.array([end_id], "<u4").tobytes(), b"", *special.values()]
        base = len(parts) - len(special) - 2
        if special:
            of = np.full(len(texts), -1)
            of[list(special)] = base + 2 + np.arange(len(special))
            doc = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], ends])))
            codes = np.where(of[doc] >= 0, base + 1, codes)
            last = np.where(of >= 0, of, base + 1)
            codes = np.insert(codes, np.repeat(ends, 2), np.stack([last, np.full(len(texts), base)], axis=1).ravel())
            ends = ends + 2 * np.arange(1, len(texts) + 1)
        else:
            codes = np.insert(codes, ends, base)
            ends = ends + np.arange(1, len(texts) + 1)
        flat, stops = spread(parts, codes, ends)
        return flat, np.diff(np.concatenate([[0], stops]))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = (_WORD_UNITS if self.words else _BYTE_UNITS).findall
        out = []
        for t in texts:
            out.append(self._whole([t])[0] if _ODD_SPACE.search(t) else b"".join(self.memo.values(cut(t))))
        return out
