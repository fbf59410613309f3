"""Edit-aware token counts on pre-token segment trees.

A document's text is cut into leaves, runs of whole pre-tokens of about ``LEAF_CHARS``
characters.  Cuts are made where a letter or number is followed by a space, a line feed or a sign: every
pre-token pattern of this family begins a new pre-token there and looks at nothing before it,
so the tokens of a text are the tokens of its leaves.  A tree over the leaves holds
characters and tokens of every subtree.

An edit re-encodes the leaves it touches, with the neighbouring leaf wherever the edit
reaches a leaf's end (the boundary context: the cut there may no longer hold), and updates the
sums on the paths above.  Untouched leaves are never read again.  Trees are stored as two
arrays per document, so counts follow later edits without encoding the text anew.

Edits of a document are (start, end, text) in characters of the text before any edit.  They
are applied from the last to the first; starts and ends beyond the text are cut to it, an
edit that overlaps an earlier one keeps what lies after it, and edits with a null start or end
are ignored; a null replacement is empty.

Defined results: null texts count as empty and have no leaves; rows with null or repeated ids
are counted each; very long texts are cut like others, and a stretch without any cut is
one leaf.  Columns named ``leaf_chars``, ``leaf_tokens`` or ``edits`` are replaced by the functions that make them; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import text as tx

LEAF_CHARS, FAN = 512, 8
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that this rank file's vocabulary is used with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: After a letter or number: a space, a line feed, or a sign that is no apostrophe (which may begin a contraction).
_CUT = re.compile(r"(?<=[^\W_])(?:[ \n]|[^\w\s'])")


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("quarry", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut_leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + size) if at + size < len(text) else None
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


class Node:
    """A subtree: its characters, tokens and leaves."""

    __slots__ = ("chars", "kids", "leaves", "tokens")

    def __init__(self, chars: int = 0, tokens: int = 0, kids: list[Node] | None = None):
        self.kids = kids
        if kids is None:
            self.chars, self.tokens, self.leaves = chars, tokens, 1
        else:
            self.update()

    def update(self) -> None:
        self.chars = sum(k.chars for k in self.kids)
        self.tokens = sum(k.tokens for k in self.kids)
        self.leaves = sum(k.leaves for k in self.kids)


def grow(nodes: list[Node]) -> Node:
    """A tree over nodes of one height."""
    while len(nodes) > FAN:
        nodes = [Node(kids=nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
    return Node(kids=nodes)


def locate(root: Node, at: int) -> tuple[int, int]:
    """(leaf number, its first character) of the leaf with character ``at``; the last leaf if there is none."""
    node, number, start = root, 0, 0
    while node.kids is not None:
        for i, k in enumerate(node.kids):
            if at < start + k.chars or i == len(node.kids) - 1:
                node = k
                break
            number += k.leaves
            start += k.chars
    return number, start


def _splice(node: Node, a: int, b: int, new: list[Node]) -> list[Node]:
    """Replace leaves a..b of a subtree; gives its sums anew, split where it grew too wide."""
    if node.kids[0].kids is None:
        kids = node.kids[:a] + new + node.kids[b:]
    else:
        kids, at, put = [], 0, False
        for i, k in enumerate(node.kids):
            held = k.leaves  # a splice below changes it
            lo, hi = max(a - at, 0), min(b - at, held)
            mine = not put and (a - at < held or i == len(node.kids) - 1)
            if mine:
                kids += _splice(k, lo, max(lo, hi), new)
                put = True
            elif put and lo < hi:
                kids += _splice(k, lo, hi, [])
            else:
                kids.append(k)
            at += held
    if not kids:
        return []
    if len(kids) <= 2 * FAN:
        node.kids = kids
        node.update()
        return [node]
    return [Node(kids=kids[i : i + FAN]) for i in range(0, len(kids), FAN)]


def leaves_of(node: Node) -> list[Node]:
    if node.kids is None:
        return [node]
    return [x for k in node.kids for x in leaves_of(k)]


class Document:
    """A text, its tree, and how many leaves were encoded since it was made."""

    def __init__(self, text: str, encode, chars: list[int] | None = None, tokens: list[int] | None = None):
        self.text, self.encode, self.encoded = text, encode, 0
        if chars is None or tokens is None:
            nodes = self._leaves(text)
        else:
            nodes = [Node(c, t) for c, t in zip(chars, tokens, strict=True)]
        self.root = grow(nodes) if nodes else None

    def _leaves(self, text: str) -> list[Node]:
        pieces = cut_leaves(text)
        self.encoded += len(pieces)
        return [Node(len(p), len(self.encode(p))) for p in pieces]

    @property
    def n_tokens(self) -> int:
        return self.root.tokens if self.root else 0

    def edit(self, start: int, end: int, new: str) -> None:
        self.apply([(start, end, new)])

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits in order, within the text and apart (see ``tidy``); those that reach common leaves are one region, and the text is put together once."""
        if not edits:
            return
        regions: list[tuple[int, int, int, int, list]] = []  # first and last leaf, their first and last character, edits
        for edit in edits:
            first = last = begin = stop = 0
            if self.root is not None:
                first, begin = locate(self.root, max(0, edit[0] - 1))
                last, last_begin = locate(self.root, min(edit[1], len(self.text) - 1))
                stop = last_begin + leaf_at(self.root, last).chars
            if regions and first <= regions[-1][1]:
                f, _, b, _, held = regions[-1]
                regions[-1] = (f, max(last, regions[-1][1]), b, max(stop, regions[-1][3]), [*held, edit])
            else:
                regions.append((first, last, begin, stop, [edit]))
        out, at, made = [], 0, []
        for _, _, begin, stop, held in regions:
            parts, here = [], begin
            for start, end, new in held:
                parts += [self.text[here:start], new]
                here = end
            region = "".join([*parts, self.text[here:stop]])
            made.append(self._leaves(region))
            out += [self.text[at:begin], region]
            at = stop
        out.append(self.text[at:])
        # from the last to the first, so that leaf numbers hold
        for (first, last, *_), leaves in zip(reversed(regions), reversed(made), strict=True):
            kept = _splice(self.root, first, last + 1, leaves) if self.root is not None else leaves
            while len(kept) > 1 or (kept and kept[0].kids is None):
                kept = [grow(kept)]
            self.root = kept[0] if kept else None
        self.text = "".join(out)


def leaf_at(root: Node, number: int) -> Node:
    node = root
    while node.kids is not None:
        for k in node.kids:
            if number < k.leaves:
                node = k
                break
            number -= k.leaves
    return node


def tidy(edits: list[tuple], size: int) -> list[tuple[int, int, str]]:
    """Edits in order, within the text and apart."""
    out, at = [], 0
    for start, end, new in sorted((s, e, t or "") for s, e, t in edits if s is not None and e is not None):
        start, end = min(max(start, at), size), min(max(end, start), size)
        end = max(start, end)
        out.append((start, end, new))
        at = end
    return out


def build_trees(docs: DataFrame, tokenizer: str = TOKENIZER, text_col: str = "text") -> DataFrame:
    """docs with leaf_chars and leaf_tokens, the stored form of each document's tree."""
    from pyspark.sql import types as T

    own = docs.drop("leaf_chars", "leaf_tokens")

    def run(batches):
        encode = encoder(tokenizer).encode_ordinary
        for batch in tx.chunks(batches, text_col):
            chars, tokens = [], []
            for text in batch.column(text_col).to_pylist():
                pieces = cut_leaves(text or "")
                chars.append([len(p) for p in pieces])
                tokens.append([len(encode(p)) for p in pieces])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chars, kind), pa.array(tokens, kind)], [*batch.schema.names, "leaf_chars", "leaf_tokens"])

    ints = T.ArrayType(T.IntegerType())
    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("leaf_chars", ints), T.StructField("leaf_tokens", ints)]))


def count_edited(trees: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", with_text: bool = True) -> DataFrame:
    """Apply each row's edits (array of (start, end, text)) to its text and tree.

    Returns doc_id, n_edits, tokens_before, tokens_after, n_leaves, reencoded_leaves, and with
    the text also text, leaf_chars and leaf_tokens after the edits.
    """
    base = trees.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits"), "leaf_chars", "leaf_tokens")
    d = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {d}, n_edits int, tokens_before long, tokens_after long, n_leaves int, reencoded_leaves int"
    if with_text:
        schema += ", text string, leaf_chars array<int>, leaf_tokens array<int>"

    def run(batches):
        encode = encoder(tokenizer).encode_ordinary
        for batch in tx.chunks(batches, "text"):
            rows = []
            for text, edits, chars, tokens in zip(*(batch.column(c).to_pylist() for c in ("text", "edits", "leaf_chars", "leaf_tokens")), strict=True):
                doc = Document(text or "", encode, chars or [], tokens or [])
                before = doc.n_tokens
                todo = tidy([(x["start"], x["end"], x["text"]) for x in edits or []], len(doc.text))
                doc.apply(todo)
                leaves = leaves_of(doc.root) if doc.root else []
                row = (len(todo), before, doc.n_tokens, len(leaves), doc.encoded)
                if with_text:
                    row += (doc.text if todo else text, [x.chars for x in leaves], [x.tokens for x in leaves])
                rows.append(row)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            names = ["n_edits", "tokens_before", "tokens_after", "n_leaves", "reencoded_leaves", "text", "leaf_chars", "leaf_tokens"]
            width = len(rows[0]) if rows else (8 if with_text else 5)
            columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names[:width]])

    return base.mapInArrow(run, schema)


_MAIL = r"[\w.+-]++@[\w-]+(?:\.[\w-]+)+"
#: What the production query edits out: mail addresses, and secrets and telephone numbers.
MAIL, MAIL_HERE = re.compile(r"(?<![\w.+-])" + _MAIL), re.compile(_MAIL)
OTHERS = re.compile(r"\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]\s*\S+|(?<![\w+])\+?\d[\d ()./-]{7,}\d(?!\w)", re.I)


def redacted(text: str) -> list[tuple[int, int]]:
    """Places of personal data and secrets, from the left and apart; of two that begin together the address wins.

    An address is looked for at the first character of its run only (or where the last place ended inside a run), so long runs are read once.
    """
    out, at, mail, other = [], 0, None, None
    begun = False
    while True:
        if not begun or (mail and mail.start() < at):
            mail = (at and MAIL_HERE.match(text, at)) or MAIL.search(text, at)
        if not begun or (other and other.start() < at):
            other = OTHERS.search(text, at)
        begun = True
        found = min((m for m in (mail, other) if m), key=lambda m: m.start(), default=None)
        if found is None:
            return out
        out.append(found.span())
        at = found.end()


def redactions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with edits that replace personal data and secrets by a mark."""
    from pyspark.sql import types as T

    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))
    own = docs.drop("edits")

    def run(batches):
        arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
        for batch in tx.chunks(batches, text_col):
            edits = [[{"start": a, "end": b, "text": "[redacted]"} for a, b in redacted(t or "")] for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, arrow)], [*batch.schema.names, "edits"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("edits", kind)]))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of every document before and after its personal data and secrets are edited out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_edited(redactions(build_trees(docs)), with_text=False)
