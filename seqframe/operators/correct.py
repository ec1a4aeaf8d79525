"""Correction of sequences by the k-mer graph: the cheapest way from a start to an end that is spelt by known k-mers."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.functions.sequence import acgt_reverse_complement, kmers
from seqframe.operators.graph import hops
from seqframe.sources.tables import written

#: A correction costs this share of the sequence's length at most.
RATE = 0.1
#: How much above the cost of the first unknown node a search goes on, to ask for more nodes at once.
AHEAD = 1
OUT_SQL = "id {id}, seq string, cost int, reason string, asks array<string>"


def both_strands(df: DataFrame) -> DataFrame:
    """``kmer``: the k-mers of ``df`` and their reverse complements, once each."""
    x = df.select(F.upper("kmer").alias("kmer"))
    return x.unionByName(x.select(acgt_reverse_complement("kmer").alias("kmer"))).distinct()


def correction_links(counts: DataFrame, starts: DataFrame, ends: DataFrame, k: int) -> DataFrame:
    """``src, dst, ends``: a link between (k-1)-mers for every k-mer, and a way from the empty beginning into every start.

    Nodes of the beginning are filled up with ^ on the left. ends: whether dst is an end k-mer without its first base.
    All tables are taken on both strands.
    """
    into = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda n: F.concat(F.repeat(F.lit("^"), F.lit(k) - n), F.left("kmer", n)))
    every = both_strands(counts).unionByName(both_strands(starts).select(F.explode(into).alias("kmer"))).distinct()
    links = every.select(F.left("kmer", F.lit(k - 1)).alias("src"), F.expr("substring(kmer, 2)").alias("dst"))
    last = both_strands(ends).select(F.expr("substring(kmer, 2)").alias("end"), F.lit(True).alias("ends")).distinct()
    return links.join(last, F.col("dst") == F.col("end"), "left").select("src", "dst", F.coalesce("ends", F.lit(False)).alias("ends"))


def unfolded(known: list[dict]) -> dict[str, list[tuple[str, bool]]]:
    """Successors (base, whether the node is an end) of every node on the way of the hops known; nodes in lower case."""
    out: dict[str, list[tuple[str, bool]]] = {}
    for row in known:
        node = row["src"].lower()
        out[node] = sorted({(b[0].lower(), b[0].islower()) for b in row["hops"]})
        for bases in row["hops"]:
            at = node[1:] + bases[0].lower()
            for b in bases[1:]:
                out[at] = [(b.lower(), b.islower())]
                at = at[1:] + b.lower()
    return out


def cheapest(seq: str, after: dict[str, list[tuple[str, bool]]], k: int, rate: float) -> tuple[str | None, int | None, str, list[str]]:
    """The corrected sequence, its cost, the reason, and the nodes whose successors must be known first (then the rest is void).

    States are (node, bases of the sequence used), taken by cost, node, place. A base that fits costs nothing; one that
    is replaced, left out or put in costs 1.
    """
    seq = seq.lower()
    start, limit = "^" * (k - 1), int(len(seq) * rate)
    cost, came, heap = {(start, 0): 0}, {}, [(0, start, 0, False)]
    asks, bound = [], limit
    while heap and heap[0][0] <= bound:
        c, node, at, end = heappop(heap)
        if c > cost[node, at]:
            continue
        if end and at == len(seq) and not asks:
            out, key = [], (node, at)
            while key in came:
                key, base = came[key]
                out.append(base)
            return "".join(reversed(out)).upper(), c, "corrected", []
        if node not in after:
            asks.append(node)
            bound = min(bound, c + AHEAD)
        new = [(c + 1, node, at + 1, end, "")] if at < len(seq) else []
        for b, e in after.get(node, ()):
            new.append((c + 1, node[1:] + b, at, e, b))
            if at < len(seq):
                new.append((c + (b != seq[at]), node[1:] + b, at + 1, e, b))
        for c2, node2, at2, e2, b in new:
            if c2 < cost.get((node2, at2), 1 << 30):
                cost[node2, at2], came[node2, at2] = c2, ((node, at), b)
                heappush(heap, (c2, node2, at2, e2))
    return None, None, "over-limit" if heap else "no-path", sorted(set(asks))


def correct(seqs: DataFrame, counts: DataFrame, starts: DataFrame, ends: DataFrame, k: int, rate: float = RATE) -> DataFrame:
    """``id, seq, cost, reason``: each sequence as the graph of known k-mers would have it.

    The corrected sequence begins with a start (its k-mer without the last base), goes on by k-mers of ``counts``, ends in an end
    (without its first base), and is the one of least edit distance from the sequence; reason then is
    ``corrected``. Where that exceeds ``rate`` of the length (rounded down), reason is ``over-limit``; where no
    way is left, ``no-path``; seq and cost are null. starts, ends: tables with a column kmer of length k. Equal costs: see cheapest().

    A record's search runs in a task, on the part of the graph that it has asked for; all records ask
    together, round by round, by a join with the hops of the graph, and begin with the nodes of their own text. So
    no task holds the graph, and a search without open questions is the one over all of it. Equal ids are an error
    of the caller; null sequences give no row.
    """
    seqs = written(seqs.where(F.col("seq").isNotNull()).select("id", F.upper("seq").alias("seq")), "records")
    links = written(correction_links(counts, starts, ends, k), "links")
    base = F.right("dst", F.lit(1))
    # an end is told by a small letter
    far = hops(links, base=F.when(F.col("ends"), F.lower(base)).otherwise(base)).select(F.col("src").alias("of"), "bases")
    # hops that pass an end keep its letter small, as every step has a letter of its own
    own = seqs.select("id", F.explode(F.array_distinct(F.concat(kmers("seq", k - 1), F.array(F.lit("^" * (k - 1)))))).alias("src"))
    kind = seqs.schema["id"].dataType.simpleString()
    fields = pa.schema([("seq", pa.string()), ("cost", pa.int32()), ("reason", pa.string()), ("asks", pa.list_(pa.string()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cheapest(seq, unfolded(known), k, rate) for seq, known in zip(batch["seq"].to_pylist(), batch["known"].to_pylist(), strict=True)]
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch["id"], *columns], ["id", *fields.names])

    asked, known, done = own, None, None
    while True:
        found = asked.join(far, F.col("src") == F.col("of"), "left").groupBy("id", "src").agg(F.collect_list("bases").alias("hops"))
        known = written(found if known is None else known.unionByName(found), "known")
        graphs = known.groupBy(F.col("id").alias("i")).agg(F.collect_list(F.struct("src", "hops")).alias("known"))
        searched = seqs.join(graphs, F.col("id") == F.col("i")).select("id", "seq", "known").mapInArrow(search, OUT_SQL.format(id=kind))
        searched = written(searched, "searched")
        ended = searched.where("size(asks) = 0").drop("asks")
        done = ended if done is None else done.unionByName(ended)
        asked = searched.where("size(asks) > 0").select("id", F.explode(F.transform("asks", F.upper)).alias("src"))
        if asked.isEmpty():
            return done
        still = asked.select(F.col("id").alias("i")).distinct()
        known, seqs = (df.join(still, F.col("id") == F.col("i"), "left_semi") for df in (known, seqs))
