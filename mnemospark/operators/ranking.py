"""Ranked retrieval: BM25, vectors, rank fusion, interleaving, diversity. All operators work on many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from mnemospark.functions.numeric import POLICY, cosine
from mnemospark.functions.text import similarity
from mnemospark.operators.views import folded_in_blocks
from mnemospark.runtime import busy_partitions, checkpointed


#: Documents of a share, requests of a block, and pairs of both scored at once.
SHARE, BLOCK, CELLS = 4096, 512, 4_000_000
#: The same where few rows of a share and block come out, so that both may be larger and fewer copies are shuffled.
FEW_SHARE, FEW_BLOCK = 32_768, 8192
#: Scores nearer than this may round to the same 9 decimals.
NEAR = 1.1e-9


def bm25(queries: DataFrame, documents: DataFrame, partition: list[str] | None = None, best: int | None = None, group: str | None = None) -> DataFrame:
    """query_id, doc_id, score of all matching documents; with ``best`` only those that can be among a query's best so many
    (by score to 9 decimals, then doc_id).

    queries: query_id, terms ARRAY<STRING> (repeats add again); documents: doc_id, terms. With ``partition`` (columns of
    both sides) statistics and matches stay within equal values. Statistics cover all documents given — filter before,
    not after. Null or empty term lists match nothing but empty ones count as documents. A query_id or doc_id must not
    repeat within the partition's values. group: a column of the documents (not with ``partition``), null being a value too;
    ``best`` then counts groups, each by its best document, and the result has the column.
    """
    if not partition:
        return bm25_reach(queries, None, documents, best, group)
    part = F.to_json(F.struct(*partition))
    docs = documents.select(part.alias("__part"), "doc_id", "terms")
    # the same query_id may ask in several parts: each is a request of its own
    own = queries.select(*partition, F.struct(part.alias("__part"), "query_id").alias("query_id"), "terms")
    found = bm25_reach(own, own.select("query_id", "query_id.__part"), docs, best)
    named = queries.select(*partition, part.alias("__part")).distinct()
    return found.select("query_id.__part", "query_id.query_id", "doc_id", "score").join(named, "__part").drop("__part")


def bm25_reach(queries: DataFrame, reach: DataFrame | None, documents: DataFrame, best: int | None = None, group: str | None = None) -> DataFrame:
    """query_id, doc_id, score of requests that each ask the union of several parts of the documents.

    queries: query_id, terms; reach: query_id, __part; documents: __part, doc_id, terms. Without ``reach`` all requests ask all
    documents. Counts of documents, their lengths
    and the documents of a term are sums over a request's parts, so no part is copied for the requests that ask it.

    Requests are packed into blocks and documents into shares by hash; a block meets a share as two inverted lists in one
    vectorised pass, so a frequent term is no hot key and no row per request, term and document is ever shuffled.
    """
    return Meeting(queries, reach, documents).found(best, group)


class Meeting:
    """Requests weighed against the statistics of documents, to be held against them in blocks and shares. ``requests`` has
    query_id, terms, weights, avgdl; ``n`` is the number of documents where all requests ask all.
    """

    def __init__(self, queries: DataFrame, reach: DataFrame | None, documents: DataFrame):
        self.documents, self.q_kind, self.d_kind = documents, *(x.schema[c].dataType.simpleString() for x, c in ((queries, "query_id"), (documents, "doc_id")))
        entries = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
        counts = (F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.size("terms"), F.lit(0))).alias("dl"), F.count("terms").alias("sized"))
        cuts = lambda few: (FEW_SHARE, FEW_BLOCK) if few else (SHARE, BLOCK)
        if reach is None:
            # one part: its statistics are one row, its cuts are numbers
            n, dl, sized = documents.agg(*counts).first()
            self.n, union = n, {"n": F.lit(n), "avgdl": F.lit((dl or 0) / max(sized, 1))}
            df = documents.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            weighed = entries.join(df, "term").withColumns(union)
            m, busy = queries.count(), min(busy_partitions(documents.sparkSession), -(-n // 256))

            def sized_by(rows: DataFrame, few: bool) -> DataFrame:
                share, block = cuts(few)
                return rows.withColumns({"__part": F.lit(""), "shares": F.lit(max(-(-n // share), busy, 1)), "blocks": F.lit(max(-(-m // block), 1))})
        else:
            reach = reach.select("query_id", "__part").distinct()
            asking = reach.groupBy("__part").agg(F.count(F.lit(1)).alias("m"))
            parts = documents.groupBy("__part").agg(*counts).join(asking, "__part")
            union = reach.join(parts, "__part").groupBy("query_id").agg(F.sum("n").alias("n"), (F.sum("dl") / F.sum("sized")).alias("avgdl"))
            df = documents.select("__part", F.explode(F.array_distinct("terms")).alias("term")).groupBy("__part", "term").agg(F.count(F.lit(1)).alias("df"))
            df = entries.join(reach, "query_id").join(df, ["__part", "term"]).groupBy("query_id", "term", "qf").agg(F.sum("df").alias("df"))
            weighed = df.join(union, "query_id")

            def sized_by(rows: DataFrame, few: bool) -> DataFrame:
                share, block = cuts(few)
                return rows.join(parts.select("__part", F.ceil(F.col("n") / share).cast("int").alias("shares"), F.ceil(F.col("m") / block).cast("int").alias("blocks")), "__part")

        self.sized_by = sized_by
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        packed = weighed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("qf") * idf).alias("w")))).alias("e"), F.first("avgdl").alias("avgdl"))
        packed = packed.select("query_id", F.col("e.term").alias("terms"), F.col("e.w").alias("weights"), "avgdl")
        self.requests = packed if reach is None else packed.join(reach, "query_id")

    def held(self, requests: DataFrame, with_request: list[str], with_document: list[str], run, schema: str, few: bool = True) -> DataFrame:
        """run(documents, requests) of every share and block, as Arrow tables; ``Lists`` has the documents' terms. few: few rows
        of each come out, so blocks and shares may be large.
        """
        pick = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        keys = ["__part", "share", "block"]
        right = self.sized_by(requests, few).withColumn("block", pick("query_id", F.col("blocks"))).withColumn("share", every(F.col("shares"))).select(*keys, "query_id", "terms", "weights", "avgdl", *with_request)
        left = self.sized_by(self.documents, few).withColumn("share", pick("doc_id", F.col("shares"))).withColumn("block", every(F.col("blocks"))).select(*keys, "doc_id", F.array_join("terms", "").alias("text"), F.transform("terms", F.octet_length).alias("lengths"), *with_document)
        # a text and lengths take a third of the bytes of a list of strings
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)

    def found(self, best: int | None = None, group: str | None = None, requests: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
        """query_id, doc_id, score (and the group), see ``bm25``. requests: some of the own ones; with ``threshold`` they have
        kept ARRAY<ARRAY<STRING>>, sets of terms, and documents as similar as that to one of a request's aren't its matches.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # fields of struct ids may be null in the result's schema
        q_type, d_type = (to_arrow_type(T.DataType.fromDDL(k)) for k in (self.q_kind, self.d_kind))
        g_type = to_arrow_type(self.documents.schema[group].dataType) if group else None

        def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
            q_ids, d_ids = asked["query_id"].combine_chunks().cast(q_type), docs["doc_id"].combine_chunks().cast(d_type)
            n_q, n_d = len(asked), len(docs)
            place = np.empty(n_d, np.int64)
            place[pc.sort_indices(d_ids).to_numpy()] = np.arange(n_d)
            of = np.arange(n_d)
            if group:
                of = np.unique(pc.fill_null(docs[group].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False), return_inverse=True)[1]
            order = np.lexsort((place, of)) if group else of
            q, d, s = np.array([], np.int64), np.array([], np.int64), np.array([])
            least = np.full(n_q, 5e-324)  # a score below isn't among the request's best
            waiting: list = []

            def gathered():
                q, d, s = (np.concatenate(x) for x in zip((q_, d_, s_), *waiting)) if waiting else (q_, d_, s_)
                if best is None or not len(q):
                    return q, d, s
                r = np.round(s, 9)
                at = np.lexsort((place[d], -r, q))
                if group:  # the first of each group
                    at = at[np.sort(np.unique(q[at] * (n_d + 1) + of[d[at]], return_index=True)[1])]
                q, d, s = q[at], d[at], s[at]
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                few = nth < best
                last = nth == best - 1
                least[q[last]] = np.maximum(least[q[last]], s[last] - NEAR)
                return q[few], d[few], s[few]

            q_, d_, s_ = q, d, s
            if n_q and n_d:
                lists = Lists(docs, order)
                scores = lists.against(asked["terms"], asked["weights"], asked["avgdl"].to_numpy())
                rows = n_q
                if threshold is not None:
                    sets = pc.list_value_length(asked["kept"].combine_chunks()).to_numpy(zero_copy_only=False)
                    some, kept = np.flatnonzero(sets), asked["kept"].combine_chunks().flatten()
                    own = pc.list_value_length(kept).to_numpy(zero_copy_only=False)
                    begin, shared = (np.cumsum(sets) - sets)[some], lists.against(kept)
                    rows = max(rows, len(kept))
                new, step = 0, max(1, CELLS // rows)
                for lo in range(0, n_d, step):
                    hi = min(n_d, lo + step)
                    total = scores(lo, hi)
                    if threshold is not None and len(some):
                        both = shared(lo, hi)
                        close = both / np.maximum(own[:, None] + lists.distinct[None, lo:hi] - both, 1) >= threshold
                        total[some] *= ~np.logical_or.reduceat(close, begin, axis=0)
                    if group:
                        total, starts = np.round(total, 9), np.flatnonzero(np.concatenate(([True], np.diff(of[order[lo:hi]]) != 0)))
                        most = np.maximum.reduceat(total, starts, axis=1)
                    else:
                        most = total
                    if best is not None and best < most.shape[1] and np.count_nonzero(most >= least[:, None]) > 2 * n_q * best:
                        least = np.maximum(least, np.partition(most, -best, axis=1)[:, -best] - NEAR)
                    if group:
                        most = np.where(most >= least[:, None], most, np.inf)
                        cell = np.flatnonzero(total == np.repeat(most, np.diff(np.append(starts, hi - lo)), axis=1))
                    else:
                        cell = np.flatnonzero(total >= least[:, None])
                    waiting.append((cell // (hi - lo), order[cell % (hi - lo) + lo], total.ravel()[cell]))
                    new += len(cell)
                    if best is not None and new > CELLS // 4:
                        q_, d_, s_ = gathered()
                        waiting, new = [], 0
                q_, d_, s_ = gathered()
            out = {"query_id": q_ids.take(pa.array(q_)), "doc_id": d_ids.take(pa.array(d_)), "score": pa.array(s_, pa.float64())}
            return pa.table(out | ({group: docs[group].combine_chunks().cast(g_type).take(pa.array(d_))} if group else {}))

        more = f", `{group}` {self.documents.schema[group].dataType.simpleString()}" if group else ""
        requests = self.requests if requests is None else requests
        return self.held(requests, [] if threshold is None else ["kept"], [group] if group else [], run, f"query_id {self.q_kind}, doc_id {self.d_kind}, score double{more}", best is not None and best <= 256)


    def newer(self, found: DataFrame, when: str) -> DataFrame:
        """Adds ``newer``, the number of the request's matches, found or not, that come before by ``when`` (an integer or time of
        the documents, latest first, null last), then doc_id. found: query_id, doc_id, when. No match is shuffled.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        q_type, d_type, w_type = (to_arrow_type(T.DataType.fromDDL(k)) for k in (self.q_kind, self.d_kind, self.documents.schema[when].dataType.simpleString()))

        def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
            q_ids, some = asked["query_id"].combine_chunks().cast(q_type), asked["some"].combine_chunks()
            owner = np.repeat(np.arange(len(asked)), pc.list_value_length(some).to_numpy(zero_copy_only=False))
            ids, times = (some.flatten().field(k).cast(t) for k, t in (("doc_id", d_type), ("when", w_type)))
            n_d, count = len(docs), np.zeros(len(owner), np.int64)
            if n_d and len(owner):
                both = {k: pa.chunked_array([docs[c].combine_chunks().cast(t), x]) for k, c, t, x in (("when", when, w_type, times), ("id", "doc_id", d_type, ids))}
                lines = pa.table(both | {"doc": pa.array(np.arange(n_d + len(owner)) < n_d)})
                line = pc.sort_indices(lines, sort_keys=[("when", "descending"), ("id", "ascending"), ("doc", "ascending")], null_placement="at_end").to_numpy()
                seat = np.empty(len(line), np.int64)
                seat[line] = np.cumsum(line < n_d)
                seat = seat[n_d:]  # documents before
                scores = Lists(docs, line[line < n_d]).against(asked["terms"], asked["weights"], asked["avgdl"].to_numpy())
                step = max(1, CELLS // len(asked))
                for lo in range(0, n_d, step):
                    hi = min(n_d, lo + step)
                    upto = np.cumsum(scores(lo, hi) > 0, axis=1, dtype=np.int32)
                    late = np.flatnonzero(seat > lo)
                    count[late] += upto[owner[late], np.minimum(seat[late], hi) - lo - 1]
            some = np.flatnonzero(count)
            return pa.table({"query_id": q_ids.take(pa.array(owner[some])), "doc_id": ids.take(pa.array(some)), "n": pa.array(count[some])})

        asked = self.requests.join(found.groupBy("query_id").agg(F.collect_list(F.struct("doc_id", F.col(when).alias("when"))).alias("some")), "query_id")
        counts = self.held(asked, ["some"], [when], run, f"query_id {self.q_kind}, doc_id {self.d_kind}, n bigint").groupBy("query_id", "doc_id").agg(F.sum("n").alias("newer"))
        return found.join(counts, ["query_id", "doc_id"], "left").withColumn("newer", F.coalesce("newer", F.lit(0)))


    def better(self, found: DataFrame) -> DataFrame:
        """Adds ``better``, the number of the request's matches, found or not, that come before by score to 9 decimals, then
        doc_id. found: query_id, doc_id, score, few of each request. No match is shuffled.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        q_type, d_type = (to_arrow_type(T.DataType.fromDDL(k)) for k in (self.q_kind, self.d_kind))

        def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
            q_ids, some = asked["query_id"].combine_chunks().cast(q_type), asked["some"].combine_chunks()
            each = pc.list_value_length(some).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(asked)), each)
            ids, marks = some.flatten().field("doc_id").cast(d_type), np.round(some.flatten().field("score").to_numpy(zero_copy_only=False), 9)
            n_d, count = len(docs), np.zeros(len(owner), np.int64)
            if n_d and len(owner):
                lines = pa.table({"id": pa.chunked_array([docs["doc_id"].combine_chunks().cast(d_type), ids]), "doc": pa.array(np.arange(n_d + len(owner)) < n_d)})
                line = pc.sort_indices(lines, sort_keys=[("id", "ascending"), ("doc", "ascending")]).to_numpy()
                seat = np.empty(len(line), np.int64)
                seat[line] = np.cumsum(line < n_d)
                seat = seat[n_d:]
                scores = Lists(docs, line[line < n_d]).against(asked["terms"], asked["weights"], asked["avgdl"].to_numpy())
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
                step = max(1, CELLS // len(asked))
                for lo in range(0, n_d, step):
                    hi = min(n_d, lo + step)
                    total = scores(lo, hi)
                    total = np.where(total > 0, np.round(total, 9), -1.0)
                    for k in range(int(nth.max()) + 1):
                        x = np.flatnonzero(nth == k)
                        own, mark = total[owner[x]], marks[x, None]
                        count[x] += np.count_nonzero((own > mark) | ((own == mark) & (np.arange(lo, hi) < seat[x, None])), axis=1)
            some = np.flatnonzero(count)
            return pa.table({"query_id": q_ids.take(pa.array(owner[some])), "doc_id": ids.take(pa.array(some)), "n": pa.array(count[some])})

        asked = self.requests.join(found.groupBy("query_id").agg(F.collect_list(F.struct("doc_id", "score")).alias("some")), "query_id")
        counts = self.held(asked, ["some"], [], run, f"query_id {self.q_kind}, doc_id {self.d_kind}, n bigint").groupBy("query_id", "doc_id").agg(F.sum("n").alias("better"))
        return found.join(counts, ["query_id", "doc_id"], "left").withColumn("better", F.coalesce("better", F.lit(0)))


class Lists:
    """The terms of a share's documents in a given order, to be held against lists of terms (in the worker)."""

    def __init__(self, docs, order):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lengths = docs["lengths"].combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(lengths), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = lengths.flatten()
        ends = np.concatenate(([0], np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64))))
        data = b"".join(x.as_buffer() for x in docs["text"].cast(pa.large_binary()).combine_chunks() if x.is_valid)
        terms = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(data))
        codes = (pc.if_else(lengths.is_valid(), terms, None) if lengths.null_count else terms).dictionary_encode(null_encoding="encode")
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        self.words, v = codes.dictionary.cast(pa.string()), max(len(codes.dictionary), 1)
        code, self.tf = np.unique(np.repeat(at, sizes) * v + codes.indices.to_numpy(zero_copy_only=False), return_counts=True)
        self.doc, self.word = code // v, code % v
        self.length, self.distinct = sizes[order], np.bincount(self.doc, minlength=len(order))

    def against(self, terms, weights=None, avgdl=None):
        """A function of a range of documents: BM25 scores, or without weights the number of shared terms, of lists x documents.

        Terms of many lists and documents are multiplied as matrices, the others meet one by one.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        k1, b = POLICY["bm25_k1"], POLICY["bm25_b"]
        terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
        n_q = len(terms)
        sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        known = terms.flatten().dictionary_encode()
        v = len(known.dictionary)
        code = known.indices.to_numpy(zero_copy_only=False)
        by = np.argsort(code, kind="stable")
        owner = np.repeat(np.arange(n_q), sizes)[by]
        weight = np.ones(len(by), np.float32) if weights is None else weights.combine_chunks().flatten().to_numpy(zero_copy_only=False)[by]
        begin = np.searchsorted(code[by], np.arange(v + 1))
        of_word = pc.fill_null(pc.index_in(self.words, value_set=known.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64) if v else np.full(len(self.words), -1)
        term = of_word[self.word] if len(self.words) else np.array([], np.int64)
        hit = term >= 0
        doc, tf, term = self.doc[hit], self.tf[hit], term[hit]
        one = weights is None or len(avgdl) < 2 or np.ptp(avgdl) == 0

        def value(d, f, q):
            if weights is None:
                return np.ones(len(d), np.float32)
            return f * (k1 + 1) / (f + k1 * (1 - b + b * self.length[d] / (avgdl[0] if q is None else avgdl[q])))

        # a cell of the product costs about a hundredth of a meeting
        dense = np.diff(begin) * np.bincount(term, minlength=v) * 100 > n_q * len(self.length) if one else np.zeros(v, bool)
        column = np.cumsum(dense) - 1
        left = np.zeros((n_q, int(dense.sum())), weight.dtype)
        own = np.repeat(dense, np.diff(begin))
        left[owner[own], column[code[by][own]]] = weight[own]
        edge = np.searchsorted(doc, np.arange(len(self.length) + 1))
        meets = np.where(dense[term], 0, np.diff(begin)[term])
        upto = np.concatenate(([0], np.cumsum(meets)))

        def between(lo, hi):
            x, y = edge[lo], edge[hi]
            p = np.arange(x, y)[dense[term[x:y]]]
            right = np.zeros((hi - lo, left.shape[1]), left.dtype)
            right[doc[p] - lo, column[term[p]]] = value(doc[p], tf[p], None)
            total = left @ right.T
            flat = total.reshape(-1)
            while x < y:
                z = min(y, max(x + 1, int(np.searchsorted(upto, upto[x] + CELLS, side="right")) - 1))
                p = np.arange(x, z)[meets[x:z] > 0]
                m = meets[p]
                e = np.repeat(begin[term[p]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                d, q = np.repeat(doc[p], m), owner[e]
                part = weight[e] * (np.repeat(value(doc[p], tf[p], None), m) if one else value(d, np.repeat(tf[p], m), q))
                np.add.at(flat, q * (hi - lo) + d - lo, part)
                x = z
            return total

        return between


def hashed_vectors(documents: DataFrame, dimensions: int = 512) -> DataFrame:
    """doc_id, bucket, value: sparse vectors of hashed terms, each (1 + ln tf) signed by the hash's top bit, L2-normalised;
    cells that cancel out are left out, and so are documents without terms.

    documents: doc_id, terms. A vector needs its own document only, so nothing is shuffled; a worker hashes a term once.
    """
    import numpy as np
    import pandas as pd

    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(frames):
        known: dict[str, int] = {}
        for frame in frames:
            ids, buckets, values = [], [], []
            for doc, terms in zip(frame["doc_id"], frame["terms"]):
                if terms is None or not len(terms):
                    continue
                if len(known) > 1_000_000:
                    known.clear()
                words, tf = np.unique(np.asarray(terms, object), return_counts=True)
                for w in words:
                    if w not in known:
                        known[w] = fnv1a_of(w)
                h = np.array([known[w] for w in words], np.int64)
                x = np.zeros(dimensions)
                np.add.at(x, h % dimensions, np.where(h >> 31 == 1, -1.0, 1.0) * (1 + np.log(tf)))
                cells = np.flatnonzero(np.abs(x) > 1e-9)
                norm = np.sqrt((x * x).sum())
                ids += [doc] * len(cells)
                buckets.append(cells)
                values.append(x[cells] / norm)
            yield pd.DataFrame({"doc_id": ids, "bucket": np.concatenate([np.array([], np.int64), *buckets]), "value": np.concatenate([np.array([]), *values])})

    return documents.select("doc_id", "terms").mapInPandas(run, f"doc_id {kind}, bucket bigint, value double")


def fnv1a_of(term: str) -> int:
    """32-bit FNV-1a over the UTF-16 code units of a term."""
    data = term.encode("utf-16-le", "surrogatepass")
    h = 2166136261
    for i in range(0, len(data), 2):
        h = ((h ^ (data[i] | data[i + 1] << 8)) * 16777619) & 0xFFFFFFFF
    return h


def ranked(scored: DataFrame, by: list[str], order: list[Column], name: str = "rk") -> DataFrame:
    """Adds the 1-based rank of each row within ``by``."""
    return scored.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top(scored: DataFrame, by: list[str], k: int, tie: str) -> DataFrame:
    """The best ``k`` rows of each group with rank ``rk``; scores are compared to 9 decimals, ties by ``tie``."""
    return ranked(scored, by, [F.round("score", 9).desc(), F.col(tie)]).where(F.col("rk") <= k)


def cosine_neighbours(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rk: the ``k`` nearest other vectors of each query by cosine, exact.

    queries: query_id, v; vectors: vec_id, v (ARRAY<DOUBLE>). The stated query set is held against all vectors in blocks:
    queries are packed into blocks of 512, every task multiplies its vectors with a block as matrices and keeps the
    block's best k of its rows, so k rows per query and task are shuffled.
    """
    import numpy as np
    import pandas as pd

    spark = vectors.sparkSession
    packed = queries.select("query_id", "v").withColumn("block", F.pmod(F.xxhash64("query_id"), F.greatest(F.lit(1), F.lit(queries.count() // 512))))
    blocks = packed.groupBy("block").agg(F.collect_list("query_id").alias("ids"), F.collect_list("v").alias("vs"))
    shares = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // 65_536))  # a share fits a task
    spread = vectors.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(shares)).alias("share"))
    copies = blocks.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shares - 1).cast("bigint"))))

    def best(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            ids = rows["vec_id"].to_numpy()
            m = np.stack(rows["v"].to_numpy())
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            for q_ids, q_vs in zip(asked["ids"], asked["vs"]):
                q = np.stack(list(q_vs))
                s = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)) @ m.T
                for i, q_id in enumerate(q_ids):
                    own = np.round(np.where(ids == q_id, -np.inf, s[i]), 9)
                    keep = np.lexsort((ids, -own))[:k]
                    out += [(q_id, ids[j], own[j]) for j in keep if own[j] > 0]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    kind = dict(vectors.dtypes)["vec_id"]
    found = spread.groupBy("share").cogroup(copies.groupBy("share")).applyInPandas(best, f"query_id {kind}, vec_id {kind}, score double")
    return top(found, ["query_id"], k, "vec_id")


def reciprocal_rank_fusion(lists: DataFrame, by: list[str], item: str) -> DataFrame:
    """Sum of weight / (60 + rk) per item. lists: by, item, list_no, rk, weight; lists of weight 0 or less are dropped.

    Adds ``first_seen`` (least (list_no, rk)), the tie order of the fused list.
    """
    used = lists.where("weight > 0")
    return used.groupBy(*by, item).agg(F.sum(F.col("weight") / (POLICY["rrf_k"] + F.col("rk"))).alias("score"), F.min(F.struct("list_no", "rk")).alias("first_seen"))


def fused_with_recency(queries: DataFrame, documents: DataFrame, when: str, weight: float, k: int) -> DataFrame:
    """query_id, doc_id, score, rk: each request's lexical ranking of all matches fused with their ranking by ``when`` (latest
    first, null last, then doc_id), the best ``k``; ties of the fused score to 9 decimals by the lexical rank.

    Exact: the best k by words have at least 1 / (60 + k), and one ranked r by words has at most 1 / (60 + r) + weight / 61,
    so only the first ranks by words can be among the best k. For these the matches that are newer are counted.
    """
    c = POLICY["rrf_k"]
    least = 1 / (c + k) - weight / (c + 1) - 2 * NEAR
    most = int(1 / least - c) + 1 if least > 0 else None
    met = Meeting(queries, None, documents)
    met.requests = checkpointed(met.requests)
    lexical = ranked(met.found(most), ["query_id"], [F.round("score", 9).desc(), F.col("doc_id")])
    lexical = lexical if most is None else lexical.where(F.col("rk") <= most)
    first = checkpointed(lexical.select("query_id", "doc_id", "rk").join(documents.select("doc_id", when), "doc_id"))
    seat = lambda no, rk, weight: F.struct(F.lit(no).alias("list_no"), F.col(rk).cast("bigint").alias("rk"), F.lit(float(weight)).alias("weight"))
    both = met.newer(first, when).withColumn("recent", F.col("newer") + 1)
    lists = both.select("query_id", "doc_id", F.inline(F.array(seat(0, "rk", 1.0), seat(1, "recent", weight))))
    fused = reciprocal_rank_fusion(lists, ["query_id"], "doc_id")
    return ranked(fused, ["query_id"], [F.round("score", 9).desc(), F.col("first_seen")]).where(F.col("rk") <= k).drop("first_seen")


def interleave(lists: DataFrame, by: list[str], item: str) -> DataFrame:
    """Seat-wise merge: every list's first, then every list's second, first appearance kept; ``rk`` is the new rank.

    lists: by, item, list_no, rk.
    """
    first = lists.groupBy(*by, item).agg(F.min(F.struct("rk", "list_no")).alias("seat"))
    return ranked(first, by, [F.col("seat")]).drop("seat")


def diversify(cues: DataFrame, by: list[str], limit: int, threshold: float = POLICY["diversity_threshold"], terms: DataFrame | None = None) -> DataFrame:
    """Greedy diverse top-k: walks each group's cues by ``rk`` and skips one whose terms overlap a kept one's by the threshold.

    cues: by, id, rk, terms; or terms: id, terms, read only for the cues a round looks at. Result: by, id, rk (old), pick (new rank). A threshold of 1 or more is plain
    top-k. The walk is exact and goes block by block, so a request with any number of cues never fills a task.
    """
    if threshold >= 1:
        return ranked(cues.where(F.col("rk") <= limit), by, [F.col("rk")], "pick").select(*by, "id", "rk", "pick")
    kind = f"array<struct<rk:int,id:{dict(cues.dtypes)['id']},terms:array<string>>>"
    own = F.array_distinct("terms").alias("terms")
    attach = None if terms is None else lambda part: part.join(terms.select("id", own), "id")

    def step(kept: Column, x: Column) -> Column:
        close = F.exists(kept, lambda y: similarity(y["terms"], x["terms"], True) >= threshold)
        return F.when((F.size(kept) >= limit) | close, kept).otherwise(F.concat(kept, F.array(x)))

    rows = cues.select(*by, "id", F.col("rk").cast("int").alias("rk"), *([own] if terms is None else []))
    walked = folded_in_blocks(rows, by, "rk", F.struct("rk", "id", "terms"), F.array().cast(kind), step, F.size("state") < limit, attach=attach)
    return walked.select(*by, F.posexplode("state").alias("pos", "x")).select(*by, "x.id", "x.rk", (F.col("pos") + 1).alias("pick"))


def diverse_matches(queries: DataFrame, documents: DataFrame, limit: int, threshold: float, some: int = 32) -> DataFrame:
    """query_id, doc_id, rk, pick: of each request's matches, by BM25, the first ``limit`` that don't restate one another.

    ``diversify`` of all matches, with the same result, but only a few of them leave their share. Each round takes the best
    ``some`` that aren't as similar as ``threshold`` to one already kept; the first of these is kept for certain, so there
    are at most ``limit`` rounds. rk, the rank among all matches, is counted at the end.
    """
    met = Meeting(queries, None, documents)
    met.requests = checkpointed(met.requests)
    if threshold >= 1:
        return top(met.found(limit), ["query_id"], limit, "doc_id").select("query_id", "doc_id", "rk", F.col("rk").alias("pick"))
    texts = documents.select("doc_id", F.array_distinct("terms").alias("terms"))
    item = F.struct("nth", "score", "doc_id", "terms")

    def step(kept: Column, x: Column) -> Column:
        close = F.exists(kept, lambda y: similarity(y["terms"], x["terms"], True) >= threshold)
        return F.when((F.size(kept) >= limit) | close, kept).otherwise(F.concat(kept, F.array(x)))

    empty = F.array().cast(f"array<struct<nth:int,score:double,doc_id:{met.d_kind},terms:array<string>>>")
    requests, ended = met.requests.withColumn("state", empty), []
    while True:
        asked = requests.withColumn("kept", F.col("state.terms"))
        found = ranked(met.found(some, requests=asked, threshold=threshold), ["query_id"], [F.round("score", 9).desc(), F.col("doc_id")], "nth").where(F.col("nth") <= some)
        lists = found.join(texts, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
        walked = requests.join(lists, "query_id", "left").withColumn("items", F.coalesce("items", empty))  # none: nothing is left
        walked = walked.withColumn("state", F.aggregate("items", F.col("state"), step))
        walked = checkpointed(walked.withColumn("more", (F.size("items") >= some) & (F.size("state") < limit)).drop("items"))
        ended.append(walked.where("NOT more").select("query_id", "state"))
        requests = walked.where("more").drop("more")
        if requests.isEmpty():
            break
    state = ended[0]
    for part in ended[1:]:
        state = state.unionByName(part)
    picks = checkpointed(state.select("query_id", F.posexplode("state").alias("at", "x")).select("query_id", "x.doc_id", "x.score", (F.col("at") + 1).alias("pick")))
    return met.better(picks).select("query_id", "doc_id", (F.col("better") + 1).cast("int").alias("rk"), "pick")
