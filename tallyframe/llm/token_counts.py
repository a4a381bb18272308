"""Operator 7: token counts of sections by offset-mapped attribution.

Each document is encoded once, whole, by a byte-level tokenizer. The byte lengths of its tokens give their spans; the
sections' spans are found in the same bytes; and the interval join of the two sorted lists is a binary search. A token
that crosses a boundary is allocated by a stated rule: `first` (the section that holds its first byte) or `most` (the
section that holds most of its bytes, the earlier one on a tie).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts


#: Runs of white space (fixed value: as the pattern's engine has it) that are too long for its look-ahead.
_LONG = re.compile("[\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")


class Counter:
    def __init__(self, ranks_path: str, pattern: str, rule: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.one_piece = tiktoken.Encoding("one-piece", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.rule = rule

    def ids(self, text: str) -> np.ndarray:
        """By the pattern, white space before other text is a piece but for its last character; at a text's end all of
        it is. Long runs are cut out as such pieces, as the pattern's engine would run out of stack on them."""
        parts, at = [], 0
        for run in _LONG.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            parts += [self._encode(self.encoding, text[at : run.start()]), self._encode(self.one_piece, text[run.start() : end])]
            at = end
        parts.append(self._encode(self.encoding, text[at:]))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    @staticmethod
    def _encode(encoding, text: str) -> np.ndarray:
        # without special tokens there is nothing to allow or forbid; this call returns an array at once
        return np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), dtype=np.int64)

    def sections(self, text: str | None) -> tuple[int, int, list[int]]:
        """(tokens, tokens that cross a boundary, tokens of each section). Sections are lines with their line end."""
        if not text:
            return 0, 0, []
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        starts = np.concatenate(([0], np.flatnonzero(raw[:-1] == 10) + 1))
        ends = np.append(starts[1:], len(raw))
        stop = np.cumsum(self.lengths[self.ids(text)])
        begin = np.concatenate(([0], stop[:-1]))
        a = np.searchsorted(starts, begin, side="right") - 1
        b = np.searchsorted(starts, stop - 1, side="right") - 1
        own, crossing = a.copy(), np.flatnonzero(a != b)
        if self.rule == "most":
            for t in crossing.tolist():
                best = [(min(stop[t], ends[s]) - max(begin[t], starts[s]), -s) for s in range(a[t], b[t] + 1)]
                own[t] = -max(best)[1]
        return len(stop), len(crossing), np.bincount(own, minlength=len(starts)).tolist()


def section_tokens(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", rule: str = "first") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_sections, n_crossing, section_tokens (tokens of each line in order).

    Sections are the lines of a text, each with its line end, so they cover it and section_tokens sum to n_tokens. Null
    and empty texts have no tokens and no sections. Repeated rows and keys are counted row by row; an empty table gives
    an empty result.
    """
    if rule not in ("first", "most"):
        raise ValueError(f"no such rule: {rule}")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def make():
        counter = Counter(ranks_path, pattern, rule)

        def run(texts):
            got = [counter.sections(t) for t in texts]
            return [x[0] for x in got], [len(x[2]) for x in got], [x[1] for x in got], [x[2] for x in got]

        return run

    return map_texts(rows, "text", make, "n_tokens long, n_sections long, n_crossing long, section_tokens array<int>").drop("text")
