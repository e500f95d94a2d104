"""Token counts that follow edits. A document's pre-tokens are the leaves of a balanced tree whose nodes hold the sums of
characters and tokens below them; an edit re-encodes the leaves it touches plus the context that their boundaries depend
on, puts the new pre-tokens in their place as leaves of their own, and updates the sums on the way up. The leaves are also
the text, so that an edit never copies it.

A boundary of the splitting pattern may depend on `context` characters behind it, and on nothing before it. So encoding
starts again at the leaf that holds the character `context` before the edit, and stops at the first old leaf boundary
behind the edit that is met again. CONTEXT holds for PATTERN of public_tokenizers ("'ll" looks two characters ahead, blanks
before a word one); another pattern needs its own.

Null or empty text: no pre-tokens, no tokens. Very long texts: whole, an edit costs the logarithm. An empty table gives no
rows. Edits: (start, end, new text) in characters of the text as it is then; out-of-range ends are clipped. Ties and
repeated rows: each row has its own tree. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from nearfield.llm.bpe import Memo, encoder
from nearfield.llm.common import id_and_text, per_text

#: Characters behind a pre-token that its end depends on.
CONTEXT = 2
#: Children of a node when it is made; it is split when it has twice as many.
FAN = 32


class Node:
    """kids: pre-tokens if leaf, else nodes; chars and tokens are sums over all below."""

    __slots__ = ("kids", "leaf", "chars", "tokens")

    def __init__(self, kids: list, leaf: bool, count: Memo):
        self.kids, self.leaf = kids, leaf
        self.add_up(count)

    def add_up(self, count: Memo) -> None:
        if self.leaf:
            self.chars, self.tokens = sum(map(len, self.kids)), sum(map(count.__getitem__, self.kids))
        else:
            self.chars, self.tokens = sum(k.chars for k in self.kids), sum(k.tokens for k in self.kids)


class CountedText:
    def __init__(self, text: str, split, match, count: Memo, context: int = CONTEXT):
        self.match, self.count, self.context, self.reencoded = match, count, context, 0
        self.root = self._grown(self._dealt(split(text), True))

    def _dealt(self, kids: list, leaf: bool) -> list[Node]:
        return [Node(kids[k : k + FAN], leaf, self.count) for k in range(0, len(kids), FAN)] or [Node([], True, self.count)]

    def _grown(self, nodes: list[Node]) -> Node:
        while len(nodes) > 1:
            nodes = self._dealt(nodes, False)
        return nodes[0]

    @property
    def n_tokens(self) -> int:
        return self.root.tokens

    @property
    def text(self) -> str:
        return "".join(p for p, _ in self.leaves(0))

    def leaves(self, at: int) -> Iterator[tuple[str, int]]:
        """The pre-tokens, and where each starts, from the one that holds character at; the last one at the text's end."""
        todo, begin = [(self.root, 0)], 0
        while todo:  # down to the leaf
            node, k = todo.pop()
            if node.leaf:
                while k < len(node.kids) - 1 and begin + len(node.kids[k]) <= at:
                    begin += len(node.kids[k])
                    k += 1
            else:
                while k < len(node.kids) - 1 and begin + node.kids[k].chars <= at:
                    begin += node.kids[k].chars
                    k += 1
            if node.leaf:
                for piece in node.kids[k:]:
                    yield piece, begin
                    begin += len(piece)
                at = -1  # whatever follows
            elif k < len(node.kids):
                todo += [(node, k + 1)] if k + 1 < len(node.kids) else []
                todo.append((node.kids[k], 0))

    def edit(self, start: int, end: int, new: str) -> None:
        start = min(max(start, 0), self.root.chars)
        end = min(max(end, start), self.root.chars)
        old = self.leaves(max(0, start - self.context))
        piece, begin = next(old, ("", 0))
        # held: the old text from begin on, up to `upto`; ends: where its pre-tokens end. buf: the same after the edit.
        held, ends, upto = [piece], [begin + len(piece)] if piece else [], begin + len(piece)

        def more(least: int) -> bool:
            nonlocal upto
            before = upto
            while upto < least:
                p, _ = next(old, (None, 0))
                if p is None:
                    break
                held.append(p)
                upto += len(p)
                ends.append(upto)
            return upto > before

        more(end + 1)
        grown = len(new) - (end - start)
        bounds = {begin, *ends} if piece else {0}

        def edited() -> str:
            bounds.update(ends)
            text = "".join(held)
            return text[: start - begin] + new + text[end - begin :]

        buf, at, made, take = edited(), 0, [], 16
        while True:
            behind = at >= start - begin + len(new)  # the edit lies before
            if behind and begin + at - grown in bounds:
                break
            if at == len(buf):
                if not more(upto + take):
                    break
                buf, take = edited(), 2 * take
                continue
            got = self.match(buf, at)[0]
            if at + len(got) + self.context > len(buf) and more(upto + take):
                buf, take = edited(), 2 * take  # what follows may change the match
                continue
            made.append(got)
            at += len(got)
        self.reencoded += len(made)
        self.root = self._grown(self._spliced(self.root, begin, begin + at - grown, made))
        while not self.root.leaf and len(self.root.kids) == 1:
            self.root = self.root.kids[0]

    def _spliced(self, node: Node, lo: int, hi: int, made: list[str]) -> list[Node]:
        """The nodes that take node's place when the leaves from character lo to hi, which are boundaries, become `made`."""
        kids, at, first, last = node.kids, 0, None, None
        size = len if node.leaf else lambda k: k.chars
        begins = []
        for k, kid in enumerate(kids):
            begins.append(at)
            n = size(kid)
            if first is None and (lo < at + n or k == len(kids) - 1):
                first = k
            if at < hi:
                last = k
            at += n
        if node.leaf:
            i = next((k for k, b in enumerate(begins) if b >= lo), len(kids))
            j = next((k for k, b in enumerate(begins) if b >= hi), len(kids))
            kids[i:j] = made
        elif kids:
            last = max(first, last if last is not None else first)
            put = self._spliced(kids[first], lo - begins[first], min(hi - begins[first], kids[first].chars), made)
            if last > first:
                put += self._spliced(kids[last], 0, hi - begins[last], [])
            kids[first : last + 1] = [k for k in put if k.kids]
        if len(kids) > 2 * FAN:
            return self._dealt(kids, node.leaf)
        node.add_up(self.count)
        return [node]


#: The edits that the query counts: a line that an earlier one equals goes, and e-mail addresses become a mark.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Non-overlapping edits from the last to the first, so that each one's place is right when its turn comes."""
    edits, seen, at = [], set(), 0
    for line in text.split("\n"):
        if line and line in seen:
            edits.append((at - 1, at + len(line), ""))
        else:
            seen.add(line)
            if "@" in line:
                edits += [(at + m.start(), at + m.end(), "<EMAIL>") for m in EMAIL.finditer(line)]
        at += len(line) + 1
    return edits[::-1]


@lru_cache(maxsize=2)
def _counts(vocab: bytes, pattern: str) -> Memo:
    e = encoder(vocab, pattern)
    return Memo(lambda p: len(e.piece(p)))


def edited_counts(df: DataFrame, vocab: bytes, pattern: str, edits_of=cleaning_edits, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_reencoded (pre-tokens encoded again) for each row; with_text: also the edited text."""
    sent = df.sparkSession.sparkContext.broadcast(vocab)

    def make():
        e, counts = encoder(sent.value, pattern), _counts(sent.value, pattern)

        def f(text):
            doc = CountedText(text or "", e.find, e.match, counts)
            before, edits = doc.n_tokens, edits_of(text or "")
            for x in edits:
                doc.edit(*x)
            counts.trim()
            return (before, len(edits), doc.n_tokens, doc.reencoded, *([doc.text] if with_text else []))

        return f

    return per_text(id_and_text(df, id_col, text_col), "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_reencoded long" + ", text string" * with_text, make)
