"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain - language - source: a budget in tokens is handed down from the root by the weights. A source's weight is
dealt to its languages and domains by its tokens in each; a domain or language weighs as much as what is below it. A leaf can
give its tokens ``max_repeats`` times. What a leaf can't give is handed to its siblings by their weights first; what the siblings
can't take goes up to the parent's siblings, and so on. Each leaf fills its budget by whole passes over its documents and a
prefix, in seeded random order, of one more pass. Without a column of domains there is one.

A source is short if its leaves, each given its part of the source's target, can't take it, before anything is redistributed.

The prefix is found without gathering a leaf in one task: documents fall in hash ranges, the ranges are summed, and only the
range in which the budget ends is ordered by document.

Defined cases: null and blank texts have no tokens and are in no mixture; sources are compared without case, outer blanks
and with '-' for '_'; null domains and languages are one of their own; null sources and sources without a target take no part
but count in the total; entries of the targets without documents can't reach a weight above zero; repeated target rows count
once, the largest weight wins; null weights and repeats count as zero; an empty documents table gives shares of zero.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.blocks import by_chars
from lexforge.session import materialize, ship_package

#: The vocabulary whose tokens measure sizes; a parameter, as it isn't part of this repository.
TOKENIZER = os.environ.get("LEXFORGE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Hash ranges of a leaf, as a power of two: a task orders the documents of one of them.
RANGE_BITS = 12
#: Least length of the pieces given to the tokenizer one by one.
PIECE = 20_000
# The pattern begins a new match at every blank after a non-blank, so that a text's tokens are those of its pieces cut there.
_CUT = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_pieces(text: str) -> Iterator[str]:
    """The text in pieces of PIECE characters or a little more, cut where no token reaches across."""
    at = 0
    while len(text) - at > PIECE:
        m = _CUT.search(text, at + PIECE)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def count_tokens(df: DataFrame, text_col: str, path: str = TOKENIZER) -> DataFrame:
    """``df`` without its text, with n_tokens."""
    ship_package(df.sparkSession)
    rest = [f for f in df.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(path)
        for rb in batches:
            texts, n = rb.column(text_col).to_pylist(), []
            for lo, hi in by_chars(texts):
                for t in texts[lo:hi]:
                    n.append(sum(len(e.encode_ordinary(p)) for p in token_pieces(t or "")))
            yield pa.RecordBatch.from_arrays([rb.column(f.name) for f in rest] + [pa.array(n, pa.int64())], names=[f.name for f in rest] + ["n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return df.select(*[f.name for f in rest], text_col).mapInArrow(run, f"{schema}, n_tokens long")


def plain_name(column: str):
    return F.replace(F.lower(F.trim(F.regexp_replace(F.col(column), r"^[\s ]+|[\s ]+$", ""))), F.lit("-"), F.lit("_"))


def plain_lang(column: str):
    """The language of a label: its first part, lower case; 'und' without one."""
    c = F.regexp_extract(F.lower(F.trim(column)), "^([a-z]+)", 1)
    return F.when(F.col(column).isNull() | (c == ""), "und").otherwise(c)


def _fill(total: float, weights: list[float], caps: list[float]) -> list[float]:
    """Shares of ``total`` in proportion to the weights, none above its cap; what a full one can't take goes to the others."""
    out, open_ = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    left = min(total, sum(caps[i] for i in open_))
    while open_ and left > 1e-9:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if out[i] + left * weights[i] / w >= caps[i] - 1e-9]
        if not full:
            for i in open_:
                out[i] += left * weights[i] / w
            break
        for i in full:
            left -= caps[i] - out[i]
            out[i] = caps[i]
        open_ = [i for i in open_ if i not in full]
    return out


@dataclass
class Node:
    """A domain, language or source of the tree, or the root; the path leads to it from the root."""

    path: tuple[str, ...]
    weight: float = 0.0  # part of the whole
    tokens: int = 0
    cap: float = 0.0
    wanted: float = 0.0  # by the weights alone
    first: float = 0.0  # what of that it can take, before redistribution
    budget: float = 0.0
    children: list["Node"] = field(default_factory=list)

    def walk(self) -> Iterator["Node"]:
        yield self
        for c in self.children:
            yield from c.walk()


def _pour(node: Node, budget: float) -> None:
    """Hand a budget down: children share it by weight, and what one can't take goes to its siblings."""
    node.budget = budget
    for c, b in zip(node.children, _fill(budget, [c.weight for c in node.children], [c.cap for c in node.children])):
        _pour(c, b)


def plan_tree(tokens: dict[tuple[str, str, str], int], targets: dict[str, tuple[float, int]], total: int) -> Node:
    """The filled tree; ``tokens`` by (domain, language, source). Its size follows the number of targets, languages and domains, not the documents."""
    scale = sum(w for w, _ in targets.values()) or 1.0
    own: dict[str, int] = {}
    for (_, _, s), n in tokens.items():
        own[s] = own.get(s, 0) + n
    nodes = {(): Node(())}
    for path, n in sorted(tokens.items()):
        if not n or path[2] not in targets:
            continue
        weight, repeats = targets[path[2]]
        part = weight / scale * n / own[path[2]]
        cap = float(n * repeats) if part > 0 else 0.0  # without weight a source can take nothing
        for k in range(4):
            if path[:k] not in nodes:
                nodes[path[:k]] = Node(path[:k])
                nodes[path[: k - 1]].children.append(nodes[path[:k]])
            x = nodes[path[:k]]
            x.weight, x.tokens, x.cap, x.wanted = x.weight + part, x.tokens + n, x.cap + cap, x.wanted + part * total
            x.first += min(cap, part * total)
    root = nodes[()]
    _pour(root, min(float(total), root.cap))
    return root


def source_rows(root: Node, targets: dict[str, tuple[float, int]], total: int) -> list[dict]:
    """One row for each target, summed over the tree's leaves."""
    scale, out = sum(w for w, _ in targets.values()) or 1.0, []
    leaves = [x for x in root.walk() if len(x.path) == 3]
    for s in sorted(targets):
        mine, want = [x for x in leaves if x.path[2] == s], targets[s][0] / scale * total
        first = sum(x.first for x in mine)
        out.append({"source": s, "weight": targets[s][0], "max_repeats": targets[s][1], "own": sum(x.tokens for x in mine), "wanted": want, "budget": sum(x.budget for x in mine), "short": first < want - 1e-6 * max(1.0, want)})
    return out


class Mixture:
    """The mixture of ``docs`` (doc id, text, source, lang and perhaps domain) under ``targets`` (source, target_weight, max_repeats)."""

    def __init__(self, docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", domain: str | None = None, path: str = TOKENIZER, seed: int = 17):
        self.spark, self.seed = docs.sparkSession, seed
        of = F.lit("all") if domain is None else F.coalesce(F.lower(F.trim(domain)), F.lit("none"))
        base = docs.select(F.col(doc_id).alias("doc_id"), of.alias("domain"), plain_lang(lang).alias("lang"), plain_name(source).alias("source"), F.when(F.trim(text) != "", F.col(text)).alias("text"))
        self.sized = materialize(count_tokens(base, "text", path).where("n_tokens > 0"), "mix-sizes")
        sums = {(r.domain, r.lang, r.source): r.n for r in self.sized.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("n")).toLocalIterator()}
        self.total = sum(sums.values())
        rows = targets.select(plain_name("source").alias("s"), F.col("source").alias("label"), F.coalesce("target_weight", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(0)).alias("m"))
        goals = {}
        for r in rows.where("s is not null").orderBy("s", F.desc("w"), "label").toLocalIterator():
            goals.setdefault(r.s, (r.w, r.m, r.label))
        self.labels = {s: g[2] for s, g in goals.items()}
        plain = {s: g[:2] for s, g in goals.items()}
        self.root = plan_tree({k: n for k, n in sums.items() if k[2] in goals}, plain, self.total)
        self.sources = source_rows(self.root, plain, self.total)

    def short_sources(self) -> DataFrame:
        """Targets that can't be reached, by the filled tree."""
        rows = [(self.labels[s["source"]],) for s in self.sources if s["short"]]
        return self.spark.createDataFrame(rows, "source string")

    def documents(self) -> DataFrame:
        """(doc_id, domain, source, lang, n_tokens, n_uses): how often each document of the mixture is used."""
        key = ["domain", "lang", "source"]
        plan = [(*x.path, int(x.budget + 1e-6) // x.tokens, int(x.budget + 1e-6) % x.tokens) for x in self.root.walk() if len(x.path) == 3]
        leaves = self.spark.createDataFrame(plan, "domain string, lang string, source string, passes long, rest long")
        d = self.sized.join(F.broadcast(leaves), key).withColumn("spot", F.xxhash64("doc_id", F.lit(self.seed)))
        d = d.withColumn("range", F.shiftrightunsigned("spot", 64 - RANGE_BITS).bitwiseXOR(F.lit(1 << (RANGE_BITS - 1))).cast("int"))
        sums = d.groupBy(*key, "range").agg(F.sum("n_tokens").alias("size"))
        before = F.coalesce(F.sum("size").over(Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranges = sums.select(*key, "range", before.alias("before"), "size")
        d = d.join(F.broadcast(ranges), [*key, "range"])  # at most 2**RANGE_BITS rows a leaf
        inside = d.where("before + size <= rest").withColumn("extra", F.lit(1))
        edge = d.where("before + size > rest and before < rest")
        upto = F.sum("n_tokens").over(Window.partitionBy(*key).orderBy("spot", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
        edge = edge.withColumn("extra", (F.col("before") + upto <= F.col("rest")).cast("int"))
        none = d.where("before >= rest").withColumn("extra", F.lit(0))
        out = inside.unionByName(edge).unionByName(none)
        return out.select("doc_id", "domain", "source", "lang", "n_tokens", (F.col("passes") + F.col("extra")).alias("n_uses")).where("n_uses > 0")

    def shares(self) -> DataFrame:
        """One row for each node of the tree and one for each target: its weight, budget, tokens in the mixture and their actual share."""
        used = materialize(self.documents().groupBy("domain", "lang", "source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("used"), F.max("n_uses").alias("most")), "mix-used")
        names = ("mixture", "domain", "language", "leaf")
        rows = [(names[len(x.path)], *(x.path + (None,) * 3)[:3], x.weight, x.tokens, x.wanted, x.budget, x.first < x.wanted - 1e-6 * max(1.0, x.wanted)) for x in self.root.walk()]
        rows += [("target", None, None, s["source"], float(s["weight"]), int(s["own"]), float(s["wanted"]), float(s["budget"]), bool(s["short"])) for s in self.sources]
        goal = self.spark.createDataFrame(rows, "level string, domain string, lang string, source string, target_weight double, own_tokens long, wanted double, budget double, short boolean")
        # used tokens of all nodes above a leaf, and of its source
        up = F.array(*[F.struct(F.lit(n).alias("level"), *[(F.col(c) if k < i else F.lit(None).cast("string")).alias(c) for k, c in enumerate(("domain", "lang", "source"))]) for i, n in enumerate(names)],
                     F.struct(F.lit("target").alias("level"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("lang"), F.col("source").alias("source")))
        sums = used.select(F.explode(up).alias("at"), "used", "most").groupBy("at.level", "at.domain", "at.lang", "at.source").agg(F.sum("used").alias("used"), F.max("most").alias("most"))
        same = [goal[c].eqNullSafe(sums[c]) for c in ("level", "domain", "lang", "source")]
        r = goal.join(F.broadcast(sums), same, "left").select(goal["*"], F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("most", F.lit(0)).alias("most"))
        total = F.max(F.when(F.col("level") == "mixture", F.col("used"))).over(Window.partitionBy())  # over the nodes of the tree
        return r.select(
            "level", "domain", "lang", "source", F.round("target_weight", 9).alias("target_weight"), "own_tokens", F.round("wanted").cast("long").alias("wanted_tokens"), F.round("budget").cast("long").alias("budget_tokens"),
            F.col("used").alias("mixture_tokens"), F.round(F.col("used") / F.greatest(F.lit(1), total), 6).alias("actual_share"), F.col("most").alias("most_uses"), "short",
        )
