"""Tokenizers of one's own: Arrow functions from a table of titles to a table of tokens.

`vocabulary(titles, segment=...)` takes any function that turns titles(channel_id, title) into
rows (channel_id, w), the tokens of a title in an array. `longest_match` makes such a function
from a list of words of several syllables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.functions import arrow_udtf

#: Titles that are cut up at once.
ROWS = 4096
#: Runs of letters, digits and underscores, as the plain tokens are.
_SYLLABLE = regex.compile(r"[\p{L}\p{N}_]+")
Segmenter = Callable[[DataFrame], DataFrame]


def arrow_segmenter(cut: Callable[[str], list[str]]) -> Segmenter:
    """`cut`, from a title to its tokens, as an Arrow table function over batches of titles."""

    def run(titles: DataFrame) -> DataFrame:
        rows = titles.select("channel_id", "title")
        kind = rows.schema["channel_id"].dataType.simpleString()

        class Cut:
            def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
                for lo in range(0, batch.num_rows, ROWS):
                    own = batch.slice(lo, ROWS)
                    tokens = [cut(t) if t else [] for t in own.column(1).to_pylist()]
                    yield pa.table({"channel_id": own.column(0), "w": pa.array(tokens, pa.list_(pa.string()))})

        return arrow_udtf(Cut, returnType=f"channel_id {kind}, w array<string>")(rows.asTable())

    return run


def longest_match(words: Iterable[str]) -> Segmenter:
    """Joins syllables to the longest word of the list that begins where the last one ended.

    Words are syllables joined by blanks; case does not matter to find them, and tokens keep the
    title's own. Syllables that begin no word are tokens of their own, so an empty list gives
    the plain tokens.
    """
    known = {tuple(w.lower().split()) for w in words}
    longest = max(map(len, known), default=1)

    starts = {w[0] for w in known if len(w) > 1}

    def cut(title: str) -> list[str]:
        own = _SYLLABLE.findall(title)
        if not starts:
            return own
        low = [s.lower() for s in own]
        if starts.isdisjoint(low):
            return own
        out, at = [], 0
        for i, s in enumerate(low):
            if s not in starts or i < at:
                continue
            size = next((n for n in range(min(longest, len(own) - i), 1, -1) if tuple(low[i:i + n]) in known), 1)
            if size > 1:
                out += own[at:i]
                out.append(" ".join(own[i:i + size]))
                at = i + size
        return out + own[at:]

    return arrow_segmenter(cut)
