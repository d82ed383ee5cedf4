"""Exact duplicates: compressed radix tries whose terminal nodes hold the smallest identifiers.

Texts are equal if they are identical after every run of white space became one
space. Each map task inserts the whole bytes of its texts into a trie, so that
copies meet before the shuffle and a text leaves a task once, however many copies
it has there. Distinct texts are then dealt out by length and content hash, and
each partition inserts them, whole again, into its own trie. A terminal node
keeps the smallest identifier of its text and adds up the copies. What a text is
equal to is decided by the bytes along the trie's path; length and hash only
choose the partition.

A trie of more than ``budget`` bytes closes its largest subtrees: their texts leave
as rows, and so does every later text that reaches a closed node. Those rows, in
the shared folder like all others, are dealt out anew in a further round. A map
task's trie is emptied instead, and its copies meet in the next round.

Null texts count as empty. Of equal texts the row with the smallest identifier
stays, null identifiers last; of rows with that same identifier, the first in the
scan. Every row is returned, repeated ones too. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.store import cut

#: Bytes of labels and nodes that a task's trie may hold.
BUDGET = 128 << 20
#: Bytes that a node takes beside its label, about.
NODE = 240
#: Rows and bytes of texts in a batch that leaves a task.
_ROWS, _BYTES = 4096, 4 << 20

_SPACES = bytes(32 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))
_KIND = "kind int, id long, place long, local long, size long, route long, length long, sha string, locals array<long>, text binary"
_SCHEMA = pa.schema(
    [("kind", pa.int32())]
    + [(c, pa.int64()) for c in ("id", "place", "local", "size", "route", "length")]
    + [("sha", pa.string()), ("locals", pa.list_(pa.int64())), ("text", pa.binary())]
)
_ROW, _TEXT, _GROUP = 0, 1, 2


def normalized(text: bytes) -> bytes:
    """Every run of U+0020 and U+0009 to U+000D as one space."""
    text = text.translate(_SPACES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


class _Node:
    __slots__ = ("label", "kids", "entry", "closed")

    def __init__(self, label: bytes) -> None:
        self.label = label
        self.kids: dict[int, _Node] = {}
        self.entry = -1
        self.closed = False


class Trie:
    """A compressed radix trie; ``insert`` gives a text's number, the same for equal texts."""

    def __init__(self) -> None:
        self.root = _Node(b"")
        self.bytes = 0
        self.entries = 0
        self.alive = 0

    def _leaf(self, node: _Node, label: bytes) -> int:
        kid = _Node(label)
        node.kids[label[0]] = kid
        self.bytes += len(label) + NODE
        return self._terminal(kid)

    def _terminal(self, node: _Node) -> int:
        node.entry = self.entries
        self.entries += 1
        self.alive += 1
        return node.entry

    def insert(self, text: bytes) -> int:
        """The text's number, or -1 if it belongs to a closed subtree."""
        node, at, end = self.root, 0, len(text)
        while True:
            if node.closed:
                return -1
            if at == end:
                return node.entry if node.entry >= 0 else self._terminal(node)
            kid = node.kids.get(text[at])
            if kid is None:
                return self._leaf(node, text[at:])
            if not text.startswith(kid.label, at):
                kid = self._split(node, kid, _shared(kid.label, text, at))
            node, at = kid, at + len(kid.label)

    def _split(self, node: _Node, kid: _Node, size: int) -> _Node:
        upper = _Node(kid.label[:size])
        kid.label = kid.label[size:]
        upper.kids[kid.label[0]] = kid
        node.kids[upper.label[0]] = upper
        self.bytes += NODE
        return upper

    def texts(self, node: _Node | None = None, path: bytes = b"") -> Iterator[tuple[int, bytes]]:
        """Number and text of every terminal node at or below a node, whose path is given."""
        stack = [(node or self.root, path)]
        while stack:
            node, path = stack.pop()
            if node.entry >= 0:
                yield node.entry, path
            stack += [(kid, path + kid.label) for kid in node.kids.values()]

    def close(self) -> Iterator[tuple[int, bytes]]:
        """Number and text of what leaves the trie with its largest subtrees, until half of its bytes are free.

        The last text stays, however long it is, so every trie settles one at least.
        """
        aim = self.bytes // 2
        while self.bytes > aim and self.alive > 1:
            sizes = self._sizes()
            node, path = self.root, b""
            # Down to a subtree of at most half of the bytes, or a single text.
            while node.kids and (node is self.root or sizes[id(node)][0] > aim or sizes[id(node)][1] == self.alive):
                node = max((k for k in node.kids.values() if not k.closed), key=lambda k: sizes[id(k)][0], default=None)
                if node is None:
                    return
                path += node.label
            if sizes[id(node)][1] == self.alive:
                return
            yield from self.texts(node, path)
            self.bytes -= sizes[id(node)][0] - len(node.label) - NODE
            self.alive -= sizes[id(node)][1]
            node.kids, node.entry, node.closed = {}, -1, True

    def _sizes(self) -> dict[int, tuple[int, int]]:
        """Bytes and texts at or below every node."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.kids.values()
        out: dict[int, tuple[int, int]] = {}
        for node in reversed(order):
            below = [out[id(k)] for k in node.kids.values()]
            out[id(node)] = (len(node.label) + NODE + sum(b for b, _ in below), (node.entry >= 0) + sum(n for _, n in below))
        return out


def _shared(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of a label the text has from a place on."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == text[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class _Owners:
    """By a text's number: its owner (identifier unknown, identifier, place), copies, and the texts of map tasks that are equal to it."""

    def __init__(self) -> None:
        self.owner: list[tuple[bool, int, int]] = []
        self.size: list[int] = []
        self.locals: list[list[int]] = []

    def add(self, entry: int, owner: tuple[bool, int, int], size: int, local: list[int]) -> None:
        if entry == len(self.owner):
            self.owner.append(owner)
            self.size.append(size)
            self.locals.append(list(local))
            return
        self.owner[entry] = min(self.owner[entry], owner)
        self.size[entry] += size
        self.locals[entry] += local


class _Batch:
    """Rows on their way out."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.bytes = 0

    def add(self, row: dict) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += len(row.get("text") or b"")
        if len(self.rows) >= _ROWS or self.bytes >= _BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, schema=_SCHEMA)
        self.rows, self.bytes = [], 0


def _text_row(text: bytes, owner: tuple[bool, int, int], size: int, local: list[int], seed: int) -> dict:
    sha = hashlib.sha256(text)
    # Length and content hash choose the partition, another one in every round.
    route = int.from_bytes(hashlib.blake2b(len(text).to_bytes(8, "little") + sha.digest(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little", signed=True)
    unknown, i, place = owner
    return {"kind": _TEXT, "id": None if unknown else i, "place": place, "size": size, "route": route, "length": len(text), "sha": sha.hexdigest(), "locals": local, "text": text}


def _owner(i: int | None, place: int) -> tuple[bool, int, int]:
    return (i is None, i or 0, place)


def _meet(budget: int):
    """Map tasks: a row of every document with the number of its text, and every distinct text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        row = 0
        trie, owners, out = Trie(), _Owners(), _Batch()

        def leave() -> Iterator[pa.RecordBatch]:
            for entry, text in trie.texts():
                yield from out.add(_text_row(text, owners.owner[entry], owners.size[entry], owners.locals[entry], 0))
            yield from out.flush()

        for batch in batches:
            ids, places, locals_ = batch.column(0), [], []
            for i, text in zip(ids.to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = base + row
                row += 1
                entry = trie.insert(normalized(text))
                # The first place of a text in this trie is the text's number to all tasks.
                owners.add(entry, _owner(i, place), 1, [place] if entry == len(owners.owner) else [])
                places.append(place)
                locals_.append(owners.locals[entry][0])
            n = len(places)
            local = pa.array(locals_, pa.int64())
            full = {"kind": pa.array([_ROW] * n, pa.int32()), "id": ids, "place": pa.array(places, pa.int64()), "local": local, "route": local}
            yield pa.RecordBatch.from_arrays([full.get(f.name, pa.nulls(n, f.type)) for f in _SCHEMA], schema=_SCHEMA)
            if trie.bytes > budget:
                yield from leave()
                trie, owners = Trie(), _Owners()
        yield from leave()

    return run


def _own(budget: int, seed: int):
    """Reduce tasks: the owner of every text, told to the map tasks' texts; rows of documents pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, owners, out = Trie(), _Owners(), _Batch()
        shas: list[str] = []
        for batch in batches:
            is_text = pc.equal(batch.column("kind"), _TEXT)
            if (passing := batch.filter(pc.invert(is_text))).num_rows:
                yield passing
            for r in batch.filter(is_text).to_pylist():
                owner = _owner(r["id"], r["place"])
                entry = trie.insert(r["text"])
                if entry < 0:
                    yield from out.add(_text_row(r["text"], owner, r["size"], r["locals"], seed))
                    continue
                if entry == len(shas):
                    shas.append(r["sha"])
                owners.add(entry, owner, r["size"], r["locals"])
                if trie.bytes > budget:
                    for gone, text in trie.close():
                        yield from out.add(_text_row(text, owners.owner[gone], owners.size[gone], owners.locals[gone], seed))
                        owners.size[gone] = 0
        for (unknown, i, place), size, local, sha in zip(owners.owner, owners.size, owners.locals, shas, strict=True):
            for one in local if size else []:
                yield from out.add({"kind": _GROUP, "id": None if unknown else i, "place": place, "local": one, "size": size, "sha": sha})
        yield from out.flush()

    return run


def owners(docs: DataFrame, doc: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """Per row ``doc``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (of the normalised text)."""
    slim = docs.select(F.col(f"`{doc}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"))
    met = slim.mapInArrow(_meet(budget), _KIND).repartition("route")
    done, seed = [], 1
    while True:
        step = cut(met.mapInArrow(_own(budget, seed), _KIND), f"owners-{seed}")
        done.append(step)
        rest = step.where(F.col("kind") == _TEXT)
        size = rest.agg(F.sum(F.col("length") + NODE)).first()[0]
        if not size:
            break
        seed += 1
        met = rest.repartition(max(1, -(-2 * size // budget)), "route")
    groups = done[0]
    for step in done[1:]:
        groups = groups.unionByName(step)
    groups = groups.where(F.col("kind") == _GROUP).select("local", F.col("id").alias("keep_id"), F.col("place").alias("_keep"), F.col("size").alias("group_size"), F.col("sha").alias("text_sha256"))
    rows = done[0].where(F.col("kind") == _ROW).select("local", F.col("id").alias(doc), F.col("place").alias("_at"))
    return rows.join(groups, "local").select(doc, "keep_id", "group_size", (F.col("_at") == F.col("_keep")).alias("kept"), "text_sha256")
