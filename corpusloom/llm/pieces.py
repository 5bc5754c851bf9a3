"""SentencePiece encoding and decoding of a merge-type model, by backtracking.

A merge encoding is the one tokenization in which every two adjacent tokens would be left alone if their joined text
were merged anew. So a text is read from the left: take the longest vocabulary match (an Aho-Corasick automaton over
the vocabulary), check the pair with the token before by re-merging the two, on failure take the next shorter match,
and where none is left step back one token; a bitfield marks positions from which no continuation exists, so each is
tried once. Pair checks are remembered.

The model's pieces never hold a white-space mark behind another character (checked when the model is loaded), so no
merge crosses the border before a run of marks and words can be encoded one by one; each worker remembers words.
Characters that the vocabulary lacks fall back to byte pieces.

Defined cases: null or empty text gives the begin and end ids alone; it decodes to the empty text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Memo, coded, holds, id_and_text, list_array, only, slices, spread, tokenizer_file

MARK = "▁"
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_HELD: dict[str, PieceModel] = {}
holds("pieces", _HELD.clear)


class PieceModel:
    def __init__(self, path: str | None = None):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(tokenizer_file("piece_bpe_32k.model", path), "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or any(p.type == USER for p in model.pieces):
            raise ValueError("a merge-type model without normalization and user-defined pieces is needed")
        self.text = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.bos, self.eos, self.unk = (next(i for i, p in enumerate(model.pieces) if p.piece == x) for x in ("<s>", "</s>", "<unk>"))
        self.prefix = MARK if model.normalizer_spec.add_dummy_prefix else ""
        self.by_words = not any(MARK in p.lstrip(MARK) for p in self.id)
        self.trie = ahocorasick.Automaton()
        for p in self.id:
            self.trie.add_word(p, self.id[p])
        self.trie.make_automaton()
        self.chars = {p for p in self.id if len(p) == 1}
        self.size = list(map(len, self.text))
        self.bits = max(16, len(self.text).bit_length())
        #: For every piece, the next shorter one that it begins with (0: none).
        self.shorter = [next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), 0) if p in self.id else 0 for p in self.text]
        self.left_alone: dict[int, bool] = {}
        self.edges: dict[int, tuple | None] = {}
        self.words = Memo(lambda words: [self._word(w) for w in words], most=250_000)
        self.shown = [self._shown(i) for i in range(len(self.text))]

    @staticmethod
    def held(path: str | None = None) -> PieceModel:
        only("pieces")
        if (path or "") not in _HELD:
            _HELD[path or ""] = PieceModel(path)
        return _HELD[path or ""]

    # encoding

    def merged(self, text: str, steps: list[tuple[float, str, str]] | None = None) -> list[str]:
        """Plain merging, best rank first, leftmost first among equals. steps: gets rank and both parts of each merge."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            if steps is not None:
                steps.append((best, parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spines(self, token: int) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """The symbols at the left and at the right edge of a token while it is merged, from one character to the whole,
        each with the rank at which the next replaces it. None if the token's merges do not come in order of rank."""
        if token not in self.edges:
            text, steps = self.text[token], []
            found = self.merged(text, steps)
            ranks = [r for r, _, _ in steps]
            if found != [text] or ranks != sorted(ranks):
                self.edges[token] = None
            else:
                grown = {a + b: (a, b, r) for r, a, b in steps}
                both = []
                for side in (0, 1):
                    line, at, following = [], text, float("inf")
                    while True:
                        line.append((at, following))
                        if at not in grown:
                            break
                        at, following = grown[at][side], grown[at][2]
                    both.append(line[::-1])
                self.edges[token] = tuple(both)
        return self.edges[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two tokens anew gives these two again. left = 0: whether merging the
        token's own text gives the token (0 is no normal piece).

        The border is crossed if at some time the symbols on its two sides merge before either is replaced."""
        key = left << self.bits | right
        known = self.left_alone.get(key)
        if known is None:
            if len(self.left_alone) > 400_000:
                self.left_alone.clear()
            known = self.left_alone[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        if not left:
            return self.merged(self.text[right]) == [self.text[right]]
        one, two, rank = self.spines(left), self.spines(right), self.rank
        if one is None or two is None:
            return self.merged(self.text[left] + self.text[right]) == [self.text[left], self.text[right]]
        a, b = iter(one[1]), iter(two[0])
        (x, x_until), (y, y_until) = next(a), next(b)
        never = float("inf")
        while True:
            across = rank.get(x + y)
            if across is not None and across < x_until and across <= y_until:
                return False
            if x_until <= y_until:
                if x_until == never:
                    return True
                x, x_until = next(a)
            else:
                y, y_until = next(b)

    def backtracked(self, text: str) -> list[int]:
        """The merge encoding of a text whose characters are all in the vocabulary."""
        shorter, size, n, bits = self.shorter, self.size, len(text), self.bits
        pairs, failed = self.left_alone, None
        longest = [0] * n  # of the pieces that begin at each place; one pass of the automaton meets them by their ends
        for end, token in self.trie.iter(text):
            longest[end - size[token] + 1] = token
        tokens: list[int] = []
        at, last = 0, 0
        while at < n:
            token = longest[at]
            while True:
                while token:
                    if not failed or not failed[at + size[token] >> 3] >> (at + size[token] & 7) & 1:
                        fits = pairs.get(last << bits | token)
                        if fits or fits is None and self.compatible(last, token):
                            break
                    token = shorter[token]
                if token:
                    break
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                token = tokens.pop()
                at -= size[token]
                last = tokens[-1] if tokens else 0
                token = shorter[token]
            tokens.append(token)
            at += size[token]
            last = token
        return tokens

    def _word(self, word: str) -> bytes:
        ids: list[int] = []
        if self.chars.issuperset(word):
            ids = self.backtracked(word)
        else:
            run = ""
            for ch in [*word, ""]:
                if ch in self.chars:
                    run += ch
                    continue
                if run:
                    ids += self.backtracked(run)
                    run = ""
                if ch:
                    ids += [self.byte[b] for b in ch.encode()] if self.byte else [self.unk]
        return array("I", ids).tobytes()

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with begin and end, one after the other, and how many each has."""
        pieces = pc.split_pattern(texts, " ")
        codes, ends, distinct = coded(pieces)
        # spaces side by side, at an end, or beside a mark of the text itself form longer runs of marks
        plain = np.array([p != "" and not p.startswith(MARK) and not p.endswith(MARK) for p in distinct], bool)
        first = np.concatenate([[0], ends[:-1]])
        odd = np.add.reduceat(~plain[codes], first) > 0 if len(texts) else np.zeros(0, bool)
        if not self.by_words or not self.prefix:
            odd[:] = True
        parts = self.words.values([MARK + p for p in distinct]) if not odd.all() else [b""] * len(distinct)
        bos, eos = len(parts), len(parts) + 1
        parts += [array("I", [self.bos]).tobytes(), array("I", [self.eos]).tobytes()]
        lists = np.split(codes, ends[:-1]) if len(texts) else []
        out = []
        for i, own in enumerate(lists):
            if odd[i]:
                text = texts[i].as_py()
                text = (self.prefix + text).replace(" ", MARK) if text else ""
                units = _UNITS.findall(text) if self.by_words else [text] if text else []
                own = [len(parts)]
                parts.append(b"".join(self.words.values(units)))
            out += [[bos], own, [eos]]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat, stops = spread(parts, np.concatenate(out) if out else np.zeros(0, np.int64), np.cumsum(sizes)[2::3])
        return flat, np.diff(np.concatenate([[0], stops]))

    # decoding

    def _shown(self, i: int) -> bytes | None:
        if self.kind[i] == CONTROL:
            return b""
        if self.kind[i] == UNKNOWN:
            return " ⁇ ".encode()
        if self.kind[i] == BYTE:
            return None
        return self.text[i].replace(MARK, " ").encode()

    def decode(self, ids: np.ndarray) -> str:
        """The library's text of these ids: bytes that are no UTF-8 become U+FFFD each, one leading space is dropped."""
        shown, out, run, first = self.shown, [], bytearray(), True
        for i in ids.tolist():
            text = shown[i]
            if text is None:
                run.append(int(self.text[i][1:-1], 16))
                first = False
                continue
            if run:
                out.append(_spelled(run))
                run = bytearray()
            if first and text:
                text = text.removeprefix(b" ") if self.prefix and self.kind[i] != UNKNOWN else text
                first = False
            out.append(text)
        if run:
            out.append(_spelled(run))
        return b"".join(out).decode("utf-8", "replace")


def _spelled(run: bytearray) -> bytes:
    """A run of byte pieces: whole UTF-8 characters stand, each other byte becomes U+FFFD."""
    try:
        run.decode()
        return bytes(run)
    except UnicodeDecodeError:
        pass
    out, at = b"", 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                bytes(run[at : at + n]).decode()
                break
            except UnicodeDecodeError:
                continue
        else:
            out += "�".encode()
            at += 1
            continue
        out += run[at : at + n]
        at += n
    return out


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _encoded(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    model = PieceModel.held(path)
    for part in slices(batches):
        flat, sizes = model.encode(part.column(1))
        decoded = [model.decode(x) for x in np.split(flat, np.cumsum(sizes)[:-1])]
        yield pa.RecordBatch.from_arrays([part.column(0), list_array(flat.view("<i4"), sizes, pa.int32()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        ends = ids.offsets.to_numpy()
        flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        hashes = [hashlib.sha256(flat[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        text = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column("decoded").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(hashes, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_pieces(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> with begin and end ids, text decoded from these ids."""
    return id_and_text(df, id_col, text_col).mapInArrow(lambda batches: _encoded(batches, path), "doc_id long, ids array<int>, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """n_tokens, sha256 of the ids as little-endian unsigned 32-bit integers, sha256 of the decoded text."""
    return encoded.mapInArrow(_digested, DIGEST)


def encode_digest(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """digest(encode_pieces(df)) in one worker a task: of two in a row either may get the other's work next, and then each
    holds a model."""
    return id_and_text(df, id_col, text_col).mapInArrow(lambda batches: _digested(_encoded(batches, path)), DIGEST)
