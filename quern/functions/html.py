"""HTML to typed blocks, over Arrow batches.

Only tags with a meaning make blocks: paragraphs and headings, links, code,
emphasis, lists, quotes and description lists. Text right after a child element
belongs to a new block like the parent's. Flags and text size pass from a block
to the blocks inside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import fresh_name, ship_code

FLAGS = ("bold", "italic", "underline", "superscript", "strike", "list_item", "quote", "description", "code", "link", "in_line")
_FLAG_OF = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic", "u": "underline", "sup": "superscript", "s": "strike", "del": "strike", "li": "list_item", "ul": "list_item", "ol": "list_item", "blockquote": "quote", "dl": "description", "dt": "description", "dd": "description"}
_SIZES = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6, "p": 7}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table div section article hr form nav".split())
_SELF_CLOSING = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}

BLOCK = "struct<block_id:int,kind:string,text:string,text_size:int,flags:array<string>,href:string,alt_text:string,in_line:boolean>"


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.open: list[tuple[str, dict | None, dict]] = []  # tag, traits (None: no block), attributes
        self.current: dict | None = None

    def _traits(self, tag: str, attrs: dict) -> dict | None:
        parent_tag, parent = (self.open[-1][0], self.open[-1][1]) if self.open else ("", None)
        own = {"kind": "text", "flags": set(), "size": -1, "href": "", "alt": "", "in_line": False}
        if tag == "code":
            own["kind"], own["in_line"] = "code", parent_tag != "pre"
        elif tag == "a":
            own |= {"kind": "link", "href": attrs.get("href") or "", "alt": attrs.get("alt") or "", "size": _SIZES.get(parent_tag, -1)}
        elif tag in _SIZES:
            own["size"] = _SIZES[tag]
        elif tag in _FLAG_OF:
            own["flags"] = {_FLAG_OF[tag]}
        else:
            return None
        if parent:
            own["flags"] = own["flags"] | parent["flags"]
            own["size"] = own["size"] if own["size"] > 0 else parent["size"]
        return own

    def _begin(self, traits: dict | None) -> None:
        self.current = None
        if traits:
            self.current = {"traits": traits, "text": []}
            self.out.append(self.current)

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P and any(t == "p" for t, _, _ in self.open):
            self.handle_endtag("p")
        if tag in _SELF_CLOSING:
            same, stop = _SELF_CLOSING[tag]
            for t, _, _ in reversed(self.open):
                if t in stop:
                    break
                if t in same:
                    self.handle_endtag(t)
                    break
        traits = self._traits(tag, dict(attrs))
        if tag in _VOID:
            self._begin(self.open[-1][1] if self.open else None)
            return
        self.open.append((tag, traits, dict(attrs)))
        self._begin(traits)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        del self.open[at:]
        self._begin(self.open[-1][1] if self.open else None)

    def handle_data(self, data):
        if self.current is not None:
            self.current["text"].append(data)


def parse_blocks(html: str | None) -> list[dict]:
    """Blocks of one document in order. Blocks without text are left out,
    except links, whose address counts. Null and empty documents have none."""
    if not html:
        return []
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    out = []
    for b in parser.out:
        text, t = "".join(b["text"]), b["traits"]
        if text.strip() or t["href"]:
            out.append({"block_id": len(out), "kind": t["kind"], "text": text, "text_size": t["size"], "flags": sorted(t["flags"]), "href": t["href"], "alt_text": t["alt"], "in_line": t["in_line"]})
    return out


def raw_blocks(text: Column) -> Column:
    """The one paragraph block of a text that isn't HTML."""
    return F.array(F.struct(F.lit(0).alias("block_id"), F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(7).alias("text_size"), F.array().cast("array<string>").alias("flags"), F.lit("").alias("href"), F.lit("").alias("alt_text"), F.lit(False).alias("in_line")))


_ARROW = pa.list_(pa.struct([("block_id", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("text_size", pa.int32()), ("flags", pa.list_(pa.string())), ("href", pa.string()), ("alt_text", pa.string()), ("in_line", pa.bool_())]))


def with_blocks(df: DataFrame, html_col: str = "html", name: str = "blocks") -> DataFrame:
    """All columns of ``df`` but one called ``name``, and the blocks' array."""
    ship_code(df.sparkSession)
    keep = [c for c in df.columns if c.lower() != name.lower()]
    source = fresh_name(df, "__quern_html")
    schema = df.select(*keep).withColumn(name, F.lit(None).cast(f"array<{BLOCK}>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = pa.array([parse_blocks(h) for h in batch.column(source).to_pylist()], _ARROW)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), blocks], [*keep, name])

    return df.select(*keep, F.col(html_col).cast("string").alias(source)).mapInArrow(run, schema)


def block_text(block: Column) -> Column:
    """Text of a block to be analysed: a link adds its address and alt text."""
    return F.when(block["kind"] == "link", F.concat_ws(" ", block["text"], block["href"], block["alt_text"])).otherwise(block["text"])
