"""Main text of pages: a linear-chain CRF over leaf blocks, decoded by Viterbi."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickertone.llm import crf
from tickertone.llm.dom import Block, leaf_blocks
from tickertone.llm.labelled_pages import labelled_pages
from tickertone.llm.text import pieces

#: Pages that the model is trained on.
TRAINING_PAGES = 600
#: Place in a block up to which a mark stands at its beginning.
EARLY = 200
_LENGTHS, _DENSITIES = (1, 2, 4, 8, 15, 30, 60), (0.0, 0.2, 0.5, 0.8)
_MARKS = {"copyright": ("©", "copyright", "all rights reserved"), "cookies": ("cookie",)}


def features(blocks: list[Block]) -> list[list[str]]:
    """Features of each block: elements and hints above it, its element, its text, its place and its neighbours' elements."""
    out = []
    for i, b in enumerate(blocks):
        n_words, density = b.text.count(" ") + 1, b.linked / len(b.text)
        low = b.text.lower()
        found = {*b.around, "bias", f"tag:{b.tag}", f"parent:{b.parent}"}
        found.add(f"words:{sum(n_words > x for x in _LENGTHS)}")
        found.add(f"links:{sum(density > x for x in _DENSITIES)}")
        found.add(f"ends:{b.text[-1] if b.text[-1] in '.!?:' else ''}")
        # A mark says something else at the beginning of a block than far inside.
        places = {k: min((at for w in words if (at := low.find(w)) >= 0), default=None) for k, words in _MARKS.items()}
        found |= {f"mark:{k}" if at < EARLY else f"late:{k}" for k, at in places.items() if at is not None}
        if not any(x.startswith(("in:nav", "in:footer", "in:aside", "in:form", "in:header", "hint:")) for x in found - {"hint:content"}):
            found.add("plain")
        found.add(f"before:{blocks[i - 1].tag if i else ''}")
        found.add(f"after:{blocks[i + 1].tag if i + 1 < len(blocks) else ''}")
        out.append(sorted(found))
    return out


@lru_cache(maxsize=4)
def default_model(n_pages: int = TRAINING_PAGES, seed: int = 1) -> crf.Chain:
    """The chain trained on the labelled pages of this package."""
    return trained(labelled_pages(n_pages, seed))


def trained(pages: list[str]) -> crf.Chain:
    """A chain trained on pages whose data-label attributes say main or other; blocks without one are other."""
    sequences = []
    for page in pages:
        if blocks := leaf_blocks(page):
            sequences.append((features(blocks), [int(b.label == "main") for b in blocks]))
    return crf.train(sequences)


def main_text(page: str | None, model: crf.Chain) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, keep in zip(blocks, model.decode(features(blocks)), strict=True) if keep)


def extract(pages: DataFrame, model: crf.Chain | None = None, html: str = "html") -> DataFrame:
    """pages without html, with text and n_chars (columns of these names are replaced).

    A null or empty page has an empty text. Each row gives one row, repeated rows too.
    """
    model = model or default_model()
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(F.col(f"`{html}`").alias("__html"), *[F.col(f"`{c}`") for c in kept])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "__html"):
                texts = [main_text(x, model) for x in batch.column("__html").to_pylist()]
                columns = [batch.column(i) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return rows.mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))
