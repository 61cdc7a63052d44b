"""Documents cut into chunks along their headings and paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"(#{1,6})\s+(\S.*)")
#: Where an overlong paragraph is best cut, the best first: at the end of a line, of a sentence, at another mark that is not
#: between digits, at white space. Sentence ends and marks are those of Unicode.
_BREAKS = [regex.compile(p) for p in (r"\n", r"(?<!\d)\p{STerm}|\p{STerm}(?!\d)", r"(?<!\d)\p{Po}|\p{Po}(?!\d)", r"\s")]
#: Titles whose sections hold no content of the document.
FRONT_MATTER = frozenset(["注意事项", "前言", "目录", "公告", "声明", "编者按", "版权", "本报告以", "本刊以", "免责声明"])


def sections(text: str, dropped: frozenset[str] = FRONT_MATTER) -> list[tuple[list[str], int, list[str]]]:
    """(path of titles, level, blocks) of each section; blocks are paragraphs, and fenced code whole. Level 0 comes
    before any heading; a section with a dropped title goes, up to the next heading."""
    out: list[tuple[list[str], int, list[str]]] = [([], 0, [])]
    path: list[tuple[int, str]] = []
    block: list[str] = []
    fenced = skipped = False

    def close() -> None:
        if block and not skipped:
            out[-1][2].append("\n".join(block))
        block.clear()

    for line in text.split("\n"):
        fence = line.lstrip().startswith("```")
        title = None if fenced or fence else _HEADING.fullmatch(line.strip())
        if title:
            close()
            level = len(title[1])
            skipped = title[2].strip() in dropped
            if not skipped:
                path = [p for p in path if p[0] < level] + [(level, title[2].strip())]
                out.append(([name for _, name in path], level, []))
        elif line.strip() or fenced:
            block.append(line.rstrip())
        else:
            close()
        fenced ^= fence
    close()
    return [s for s in out if s[2]]


def split_block(block: str, most: int, overlap: int) -> list[str]:
    """Pieces of at most ``most`` characters, each beginning with the last ``overlap`` of the one before; cut at the
    best break in the last 100 characters that may be used."""
    out, at = [], 0
    while len(block) - at > most:
        low, high = at + max(overlap + 1, most - 100), at + most
        ends = (max((m.end() for m in p.finditer(block, low, high)), default=None) for p in _BREAKS)
        end = next((e for e in ends if e), high)
        out.append(block[at:end])
        at = end - overlap
    return [*out, block[at:]]


def chunk_text(text: str, most: int = 1000, overlap: int = 64) -> list[tuple[str, str]]:
    """(title, text) of each chunk. What comes before the first heading of level 3 or more is one section, any other
    is its own. Blocks are packed up to ``most`` characters and only longer ones are split; under two titles or more
    the path stands first."""
    found = sections(text)
    first = next((i for i, s in enumerate(found) if s[1] >= 3), len(found))
    head = [(found[first - 1][0][:1], [b for s in found[:first] for b in s[2]])] if first else []
    out = []
    for path, blocks in head + [(s[0], s[2]) for s in found[first:]]:
        label = f"【{' / '.join(path)}】\n" if len(path) > 1 else ""
        room = max(overlap + 2, most - len(label))
        held: list[str] = []
        for piece in (p for b in blocks for p in split_block(b, room, overlap)):
            if held and sum(map(len, held)) + len(held) + len(piece) > room:
                out.append((path[-1] if path else "", label + "\n".join(held)))
                held = []
            held.append(piece)
        if held:
            out.append((path[-1] if path else "", label + "\n".join(held)))
    return out


def chunks(docs: DataFrame, most: int = 1000, overlap: int = 64) -> DataFrame:
    """doc_id, position, title and text of each chunk; null and blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(d, i, *c) for d, t in zip(b["doc_id"].tolist(), b["text"].tolist(), strict=True) for i, c in enumerate(chunk_text(t, most, overlap))]
            yield pd.DataFrame(made, columns=["doc_id", "position", "title", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("text is not null and doc_id is not null").select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, position int, title string, text string")


def with_ids(parts: DataFrame) -> DataFrame:
    """Adds the content hash that incremental indexing compares."""
    return parts.withColumn("hash", F.sha2("text", 256))
