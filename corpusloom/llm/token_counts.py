"""Token counts under a unigram model, by dynamic programming shared along a trie.

A pre-token is a run of non-space characters with its white-space mark. Its best segmentation maximizes the sum of
the log probabilities of its pieces; the forward score of a prefix depends on that prefix alone. So the distinct
pre-tokens of a slice are inserted in a trie, the forward score and the token count of each trie node are computed
once for all pre-tokens that share the prefix, and terminals keep their count. A document's count is the sum over its
pre-tokens. Pieces and their order come from the public vocabulary file; by Zipf's law the log probability of the
piece of rank r is -ln(r + 1) up to a constant per token, ln(H) with H the harmonic sum over the vocabulary. A
character outside the vocabulary counts one token per UTF-8 byte at ten nats below the rarest piece each.

Ties go to fewer tokens, so counts do not depend on the order of the work. Defined cases: null, empty or blank text
has no pre-token and counts 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Memo, coded, holds, id_and_text, only, slices, tokenizer_file

MARK = "▁"
#: Scores are whole numbers of 1e-6 nats: sums are exact in any order.
SCALE = 1_000_000
_HELD: dict[str, UnigramTrie] = {}
holds("counts", _HELD.clear)


def unigram(path: str | None = None) -> tuple[dict[str, int], int]:
    """Costs (negated log probabilities, in 1e-6 nats) of the normal pieces and of an unknown byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model", path))
    normal = [(-model.get_score(i), i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(1, len(normal) + 1)))
    costs = {model.id_to_piece(i): round(SCALE * (math.log(rank + 2) + total)) for rank, (_, i) in enumerate(sorted(normal))}
    return costs, max(costs.values()) + 10 * SCALE


class UnigramTrie:
    """Nodes of the pre-tokens of one slice; each node stands for a prefix and holds its forward score and count."""

    def __init__(self, path: str | None = None):
        self.costs, self.unknown = unigram(path)
        self.longest = max(map(len, self.costs))
        self.memo = Memo(self.counts, most=600_000)

    @staticmethod
    def held(path: str | None = None) -> UnigramTrie:
        only("counts")
        if (path or "") not in _HELD:
            _HELD[path or ""] = UnigramTrie(path)
        return _HELD[path or ""]

    def counts(self, words: list[str]) -> list[int]:
        """Token counts of pre-tokens, given without their mark. The trie is walked in sorted order, so only the path to the current node is held:
        best[d] is (cost, tokens) of the prefix of length d, computed once for all words that share it."""
        words = [MARK + w if w else "" for w in words]
        order = sorted(range(len(words)), key=words.__getitem__)
        costs, unknown, longest = self.costs, self.unknown, self.longest
        out, last, best = [0] * len(words), "", [(0, 0)]
        for i in order:
            word = words[i]
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :]
            for d in range(shared + 1, len(word) + 1):
                ch = word[d - 1]
                cost, n = best[d - 1]
                if ch in costs:
                    node = (cost + costs[ch], n + 1)
                else:
                    size = len(ch.encode())
                    node = (cost + size * unknown, n + size)
                for a in range(max(0, d - longest), d - 1):
                    own = costs.get(word[a:d])
                    if own is not None:
                        cost, n = best[a]
                        if (cost + own, n + 1) < node:
                            node = (cost + own, n + 1)
                best.append(node)
            out[i] = best[len(word)][1]
            last = word
        return out


def count_tokens(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words long, n_tokens long; one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = UnigramTrie.held(path)
        for part in slices(batches):
            codes, ends, distinct = coded(pc.utf8_split_whitespace(part.column(1)))
            known = np.array(trie.memo.values(distinct), np.int64)
            words = np.array([w != "" for w in distinct], np.int64)
            sums = [np.concatenate([[0], np.cumsum(x[codes])])[np.concatenate([[0], ends])] for x in (words, known)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(sums[0])), pa.array(np.diff(sums[1]))], names=["doc_id", "n_words", "n_tokens"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
