"""Thinking and answer parts of a stream of text pieces, whose tags may be split between pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# The tags, and the white space that may stand before a thinking tag.
OPEN, CLOSE, ANSWER, ANSWER_END = "<think>", "</think>", "<answer>", "</answer>"
SPACES = ("", " ", "\n", "  ", "\t", " \n", "\n ", "\n\n")
#: State: the tags that count there.
TAGS = {
    "before": [*(w + t for t in (OPEN, CLOSE) for w in SPACES), ANSWER],
    "thinking": [w + CLOSE for w in SPACES],
    "after": [*(w + CLOSE for w in SPACES), ANSWER, ANSWER_END],
}
EVERY = {t for tags in TAGS.values() for t in tags}
PREFIXES = {t[:n] for t in EVERY for n in range(1, len(t))}


class TagParser:
    """Feed pieces, take (kind, text) parts; what may be the start of a tag is held back until it is told apart."""

    def __init__(self, state: str = "before", held: str = ""):
        self.state, self.held = state, held

    def _part(self, text: str) -> list[tuple[str, str]]:
        return [("thinking" if self.state == "thinking" else "answer", text)] if text else []

    def feed(self, piece: str | None, last: bool = False) -> list[tuple[str, str]]:
        self.held += piece or ""
        out = []
        while True:
            found = min(((self.held.find(t), n, t) for n, t in enumerate(TAGS[self.state]) if t in self.held), default=None)
            if found is None:
                break
            at, _, tag = found
            out += self._part(self.held[:at])
            self.held = self.held[at + len(tag) :]
            if tag.endswith(OPEN):
                self.state = "thinking"
            elif tag.endswith(CLOSE):
                self.state, self.held = "after", self.held.lstrip()
            elif tag == ANSWER:
                self.state = "after"
        longest = min(len(self.held), max(map(len, EVERY)) - 1)
        keep = 0 if last else max((n for n in range(longest + 1) if n and self.held[-n:] in PREFIXES), default=0)
        cut = len(self.held) - keep
        out += self._part(self.held[:cut])
        self.held = self.held[cut:]
        return out


def tag_parts(pieces: DataFrame) -> DataFrame:
    """conv_id, answer, thinking of each conversation's pieces (conv_id, turn, text) in the order of their turns; a
    conversation is read by one task, piece by piece. Null pieces are empty."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parser, parts = TagParser(), []
        for text in rows.sort_values("turn")["text"]:
            parts += parser.feed(text if isinstance(text, str) else "")
        parts += parser.feed("", last=True)
        joined = {kind: "".join(t for k, t in parts if k == kind) for kind in ("answer", "thinking")}
        return pd.DataFrame({"conv_id": [rows["conv_id"].iloc[0]], **{k: [v] for k, v in joined.items()}})

    return pieces.select("conv_id", "turn", "text").groupBy("conv_id").applyInPandas(run, "conv_id long, answer string, thinking string")


def tag_stream(pieces: DataFrame) -> DataFrame:
    """conv_id, turn, kind, text of the parts as they come, over a table or a stream of pieces; the state between two
    batches is the parser's own. Parts that are held back at the end of a stream are not given."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        parser = TagParser(*state.get) if state.exists else TagParser()
        out = []
        for turn, text in pd.concat(list(batches)).sort_values("turn")[["turn", "text"]].itertuples(index=False):
            out += [(key[0], turn, kind, part) for kind, part in parser.feed(text if isinstance(text, str) else "")]
        state.update((parser.state, parser.held))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "kind", "text"])

    return pieces.select("conv_id", "turn", "text").groupBy("conv_id").applyInPandasWithState(
        step, "conv_id long, turn long, kind string, text string", "state string, held string", "append", GroupStateTimeout.NoTimeout
    )
