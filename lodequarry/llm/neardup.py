"""Near duplicates by weighted Jaccard similarity of word shingles: BagMinHash signatures, banding, exact verification, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodequarry.llm import shared
from lodequarry.llm.components import components

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts, words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow array of texts: document, hash and count of each distinct shingle, by document, and shingles per document.

    A text of fewer words is one shingle; one without words has none."""
    buf, edge = shared.flat_texts(texts)
    docs = len(edge) - 1
    starts, ends = shared.word_spans(buf)
    h = shared.word_hashes(buf, starts, ends)
    doc = np.searchsorted(edge, starts, "right") - 1
    have = np.bincount(doc, minlength=docs)
    first = np.cumsum(have) - have
    n = np.where(have >= words, have - words + 1, np.minimum(have, 1))
    of = np.repeat(np.arange(docs), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
    length = np.minimum(have, words)[of]
    key = np.zeros(len(of), np.uint64)
    for k in range(words):
        more = length > k
        if more.all():
            key = shared.mix(key + h[at + k])
        else:
            key[more] = shared.mix(key[more] + h[at[more] + k])
    order = np.lexsort((key, of))
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    where = np.flatnonzero(new)
    return of[where], key[where], np.diff(np.append(where, len(key))), n


def signatures(doc: np.ndarray, key: np.ndarray, count: np.ndarray, n: np.ndarray, registers: int) -> np.ndarray:
    """BagMinHash: by document and register, the first time of a Poisson process that all documents share.

    Of every shingle, the weights (0, 1], (1, 2], (2, 4], (4, 8] ... carry processes whose rates are their lengths; each point has a
    weight within its interval and a register. A document sees the points whose weight is at most the shingle's count; the first time in
    a register is equal in two documents with probability sum(min) / sum(max) of their counts. Processes are followed
    up to a time by which most documents have a point in all registers; the others are followed for longer. No shingles: infinite times."""
    docs = len(n)
    out = np.full(docs * registers, np.inf)
    levels = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    which = np.repeat(np.arange(len(key)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    of, weight = doc[which], count[which].astype(np.float64)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1.0))
    rate = np.where(level == 0, 1.0, low)
    seed = shared.mix(key[which] + level.astype(np.uint64) * _GOLD)
    end = registers * (np.log(registers) + 5) / np.maximum(n, 1)
    t, state = np.zeros(len(which)), seed
    alive = np.arange(len(which))
    while len(alive):
        late: list[np.ndarray] = []
        while len(alive):
            s = shared.mix(state[alive] + _GOLD)
            gap = -np.log1p(-(s >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate[alive]
            new = t[alive] + gap
            on = new < end[of[alive]]
            late.append(alive[~on])  # its next point, if ever wanted, is this one again
            alive, s, new = alive[on], s[on], new[on]
            t[alive], state[alive] = new, s
            r = shared.mix(s ^ np.uint64(0xD6E8FEB86659FD93))
            place = (shared.mix(r + _GOLD) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * rate[alive] + low[alive]
            seen = place < weight[alive]
            np.minimum.at(out, of[alive[seen]] * registers + (r[seen] % np.uint64(registers)).astype(np.int64), new[seen])
        missing = np.isinf(out.reshape(docs, registers)).any(1) & (n > 0)
        if not missing.any():
            break
        end = np.where(missing, end * 2, 0.0)
        alive = np.concatenate(late)
        alive = alive[missing[of[alive]]]
    return out.reshape(docs, registers)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each run of `rows` registers, with the number of the run in it."""
    bits = signature.view(np.uint64).reshape(len(signature), -1, rows)
    out = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64) * _GOLD, bits.shape[:2]).copy()
    for k in range(rows):
        out = shared.mix(out ^ bits[:, :, k])
    return out.view(np.int64)


def _signer(words: int, n_bands: int, rows: int):
    import pyarrow as pa

    def run(batches):
        shared.release(held=True)
        for whole in batches:
            for batch in shared.slices(whole, 2 << 20):
                doc, key, count, n = shingles(batch.column(batch.schema.get_field_index("text")), words)
                made = signatures(doc, key, count, n, n_bands * rows)
                got = bands(made, rows)
                sketch = pa.array([x.tobytes() for x in (shared.mix(made.view(np.uint64)) & np.uint64(255)).astype(np.uint8)], pa.binary())
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * n_bands), pa.array(got.reshape(-1)))
                bit = np.zeros((len(n), -(-made.shape[1] // 64) * 64), np.uint8)
                bit[:, : made.shape[1]] = (shared.mix(made.view(np.uint64)) >> np.uint64(20)) & np.uint64(1)
                packed = np.packbits(bit, axis=1).view(np.int64)
                signs = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * packed.shape[1]), pa.array(packed.reshape(-1)))
                keep = [k for k, c in enumerate(batch.schema.names) if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(n), flat, sketch, signs], [*(batch.schema.names[k] for k in keep), "n", "bands", "sketch", "signs"])

    return run


def similar(a, b, words: int, least: float) -> np.ndarray:
    """Whether the shingle multisets of the texts of a and b (Arrow arrays, pairwise) have a weighted Jaccard similarity of at least `least`."""
    da, ka, ca, na = shingles(a, words)
    db, kb, cb, nb = shingles(b, words)
    doc, key, count = np.concatenate((da, db)), np.concatenate((ka, kb)), np.concatenate((ca, cb))
    order = np.lexsort((key, doc))
    doc, key, count = doc[order], key[order], count[order]
    both = np.flatnonzero((key[1:] == key[:-1]) & (doc[1:] == doc[:-1]))
    shared_ = np.bincount(doc[both], np.minimum(count[both], count[both + 1]), minlength=len(na))
    return shared_ >= least * (na + nb - shared_) - 1e-9


def _plausible(least: float):
    """Pairs whose sketches (a byte of each register) agree in so many places that the similarity may be `least`: five standard deviations below it at the least."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            a, b = (np.frombuffer(b"".join(get(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            m = a.shape[1]
            ok = pa.array((a == b).sum(1) >= m * least - 5 * np.sqrt(m * least * (1 - least)))
            yield pa.RecordBatch.from_arrays([get("a").filter(ok), get("b").filter(ok)], ["a", "b"])

    return run


def _verifier(words: int, least: float):
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            for batch in shared.slices(whole, 2 << 20, "text_b"):
                get = lambda c: batch.column(batch.schema.get_field_index(c))
                ok = pa.array(similar(get("text_a"), get("text_b"), words, least))
                yield pa.RecordBatch.from_arrays([get("a").filter(ok), get("b").filter(ok)], ["a", "b"])

    return run


SLOTS = 1 << 20  # counters of how often tokens occur; they only order tokens, so sharing one costs time, not links
_CHUNK = 1 << 12
_COUNTER = np.dtype([("at", "<u2"), ("count", "<u4")])
HEAD = 32  # tokens before its own that a prefix token carries, by which a pair is made at its first common token only


def tokens_of(texts, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and hash of each token, a shingle with the number of its occurrence, and tokens per document: multisets become sets of the same similarity."""
    doc, key, count, n = shingles(texts, words)
    which = np.repeat(np.arange(len(key)), count)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return doc[which], shared.mix(key[which] + nth.astype(np.uint64) * _GOLD), n


def _tallier(words: int):
    import pyarrow as pa

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for whole in batches:
            for batch in shared.slices(whole, 2 << 20):
                _, token, _ = tokens_of(batch.column(batch.schema.get_field_index("text")), words)
                total += np.bincount((token & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        if total.any():  # only counters that moved: many small tasks must not send all of them each
            chunks = [np.flatnonzero(total[k : k + _CHUNK]) for k in range(0, SLOTS, _CHUNK)]
            some = [k for k, at in enumerate(chunks) if len(at)]
            sent = [np.rec.fromarrays((chunks[k], np.minimum(total[k * _CHUNK + chunks[k]], (1 << 32) - 1)), dtype=_COUNTER).tobytes() for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sent, pa.binary())], ["chunk", "tally"])

    return run


def _summed(pdf):
    import pandas as pd

    total = np.zeros(_CHUNK, np.int64)
    for x in pdf["tally"]:
        counters = np.frombuffer(x, _COUNTER)
        total[counters["at"]] += counters["count"]  # each but once
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "tally": [total.tobytes()]})


def _prefixer(words: int, least: float, told):
    import pyarrow as pa

    def run(batches):
        tally = told.value
        for whole in batches:
            for batch in shared.slices(whole, 2 << 20):
                doc, token, n = tokens_of(batch.column(batch.schema.get_field_index("text")), words)
                seen = tally[(token & np.uint64(SLOTS - 1)).astype(np.int64)]
                order = np.lexsort((token, seen, doc))
                doc, token, seen = doc[order], token[order], seen[order]
                place = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
                reach = n - np.ceil(least * n - 1e-9).astype(np.int64) + 1
                use = (place < reach[doc]) & (seen > 1)
                node = batch.column(batch.schema.get_field_index("node")).to_numpy()
                doc, token, place = doc[use], token[use].view(np.int64), place[use]
                many = np.bincount(doc, minlength=len(n))
                first = (np.cumsum(many) - many)[doc]
                size = np.minimum(np.arange(len(doc)) - first, HEAD)
                edge = np.concatenate(([0], np.cumsum(size)))
                before = token[np.repeat(first - edge[:-1], size) + np.arange(edge[-1])]
                before = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(before))
                yield pa.RecordBatch.from_arrays([pa.array(node[doc]), pa.array(token), pa.array(place), before], ["node", "token", "place", "before"])

    return run


def prefixes(texts: DataFrame, words: int, least: float) -> DataFrame:
    """node, token, place, before: of each text (node, text), its rarest tokens in order, so many that two texts of a similarity of at least `least` share one of them;
    before holds the first of those that stand earlier, HEAD at most.

    That holds for any one order of all tokens; this one puts what occurs seldom first (by a bounded table of counters), so passages that very many texts share come last and
    make candidates only of texts that consist of little else. Tokens that occur once are left out, as they meet no other."""
    spark = texts.sparkSession
    tallied = shared.staged(texts.select("text").mapInArrow(_tallier(words), "chunk int, tally binary"), "tallies")
    parts = tallied.groupBy("chunk").applyInPandas(_summed, "chunk int, tally binary").collect()  # SLOTS counters
    tally = np.zeros(SLOTS, np.int64)
    for r in parts:
        tally[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["tally"], np.int64)
    told = spark.sparkContext.broadcast(np.minimum(tally, (1 << 31) - 1).astype(np.int32))
    return texts.select("node", "text").mapInArrow(_prefixer(words, least, told), "node long, token long, place long, before array<long>")


def _differ(words: int, least: float):
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            for batch in shared.slices(whole, 2 << 20):
                get = lambda c: batch.column(batch.schema.get_field_index(c))
                sets = [tokens_of(get(c), words) for c in ("text", "hub_text")]
                doc, token = (np.concatenate([x[k] for x in sets]) for k in (0, 1))
                side = np.repeat(np.arange(2, dtype=np.uint64), [len(x[0]) for x in sets])
                order = np.lexsort((token, doc))
                doc, token, side = doc[order], token[order], side[order]
                same = (doc[1:] == doc[:-1]) & (token[1:] == token[:-1])
                lone = np.ones(len(doc), bool)
                lone[1:][same] = lone[:-1][same] = False
                doc, token, side = doc[lone], token[lone], side[lone]
                n, hub_n = sets[0][2], sets[1][2]
                lacks = np.bincount(doc[side == 1], minlength=len(n))
                over = n * (least / (1 + least)) + lacks - hub_n / 2
                made = shared.mix(shared.mix(token + side) ^ get("hub").to_numpy().view(np.uint64)[doc]).view(np.int64)
                edge = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(n))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([get("node"), get("hub"), pa.ListArray.from_arrays(pa.array(edge), pa.array(made)), pa.array(over)], ["node", "hub", "unlike", "over"])

    return run


def differences(texts: DataFrame, words: int, least: float) -> DataFrame:
    """node, hub, unlike, over: of each text (node, text, hub, hub_text), the tokens in which it differs from what most texts of its hub have, hashed with the hub, and how far it is from that.

    With H tokens that most have and D those a text lacks of them, |a and b| = H - |Da| - |Db| + what a and b have in common of their differences. So two texts of one hub are as similar as `least` just if
    that is at least over(a) + over(b), over being n * least / (1 + least) + |D| - H / 2. Where the sum is not positive, both are as similar as that to the text of the hub whose over is smallest.
    That holds for any set of H tokens; the hub's own come first, then those are turned over in which more than half of its texts differ from it."""
    raw = shared.staged(texts.select("node", "text", "hub", "hub_text").mapInArrow(_differ(words, least), "node long, hub long, unlike array<long>, over double"), "unlike-hubs")
    size = raw.groupBy("hub").agg(F.count("*").alias("size"))
    often = raw.select("hub", F.explode("unlike").alias("token")).groupBy("hub", "token").agg(F.count("*").alias("k")).join(size, "hub").where("2 * k > size")
    often = often.groupBy("hub").agg(F.collect_list("token").alias("most"))
    met = raw.join(often, "hub", "left").withColumn("most", F.coalesce("most", F.array().cast("array<long>")))
    turned = F.concat(F.array_except("unlike", "most"), F.array_except("most", "unlike"))
    return met.select("node", "hub", turned.alias("unlike"), (F.col("over") + F.size("most") / 2 - F.size(F.array_intersect("unlike", "most"))).alias("over"))


def _texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """One text for each text hash that occurs in pairs: that of its representative."""
    return _texts_of(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())


def _texts_of(docs: DataFrame, nodes: DataFrame, some: DataFrame) -> DataFrame:
    wanted = some.join(nodes.select("node", "rep"), "node")
    same = F.col("d.node").eqNullSafe(F.col("w.node")) & F.col("d.doc_id").eqNullSafe(F.col("w.rep"))
    return docs.alias("d").join(wanted.alias("w"), same, "left_semi").dropDuplicates(["node"]).select("node", "text")


def _node(text, seed: int):
    return F.xxhash64(F.lit(seed), F.coalesce(text, F.lit("")))


def classes(docs: DataFrame, words: int = 5, least: float = 0.8, n_bands: int = 25, rows: int = 6, pivots: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, class_id (smallest doc_id of its class), node (hash of the text by `seed`), seed, has_words and kept.

    Classes are the connected components of texts whose shingle multisets have a similarity of `least` or more. Candidates share one of n_bands runs of `rows`
    registers (a pair at 0.8 is missed with probability 5e-4, one at 0.85 with 7e-6) and have signatures alike enough; every link is verified on the whole texts. Equal texts
    are one node. First, the members of each bucket of a band are compared with `pivots` of them, the shortest among these, so that copies never meet all of one another. Buckets whose members are then all in
    one class need no more, as classes are what is asked for. The members of the others are compared across classes, once for each pair: those with one hub (a text that both were compared with) where
    they share enough of what sets them apart from it (see differences), as any two similar texts do unless both are similar to the hub; the others where they share one of their rarest tokens (see prefixes). Nothing is cut here: candidates are left out only by bounds that every similar pair meets, and by two tests of signatures
    that a pair at exactly 0.8 fails by chance (four and five standard deviations: 1 in 30,000 and 1 in 3,000,000). Texts that merely hold one common passage do not meet.

    Texts without words (null and empty ones too) are classes of their own, row by row. A null doc_id counts as larger than all others; rows alike in doc_id
    and text fall into one class, of which one row is kept. Other columns are left aside. An empty table gives no rows."""
    plain = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    for seed in range(8):  # until no two texts share a 64-bit hash; a second hash tells
        keyed = plain.select("doc_id", "text", _node(F.col("text"), seed).alias("node"))
        source = keyed.withColumn("check", _node(F.col("text"), seed + 100))
        kind = plain.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {kind}, node long, check long, n long, bands array<long>, sketch binary, signs array<long>"
        signed = shared.staged(source.select("doc_id", "text", "node", "check").mapInArrow(_signer(words, n_bands, rows), schema), "signatures")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "n", "bands", "sketch", "signs"))
        nodes = signed.where("n > 0").groupBy("node").agg(first.alias("f"), F.min("check").alias("c"), F.max("check").alias("d"))
        nodes = shared.staged(nodes.select("node", F.col("f.doc_id").alias("rep"), "f.n", "f.bands", "f.sketch", "f.signs", (F.col("c") != F.col("d")).alias("clash")), "nodes")
        if nodes.where("clash").isEmpty():
            break
    rows_ = nodes.select("node", "n", F.explode("bands").alias("bucket"))

    def plausible(pairs: DataFrame) -> DataFrame:
        """The pairs whose sketches allow that they are similar."""
        sketch = lambda c: nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}"))
        return shared.staged(pairs.join(sketch("a"), "a").join(sketch("b"), "b").mapInArrow(_plausible(least), "a long, b long"), "pairs")

    def compared(likely: DataFrame) -> DataFrame:
        """The pairs that are similar; texts are fetched for these only."""
        texts = shared.staged(_texts(keyed, nodes, likely), "texts")
        text = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
        met = likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
        return shared.staged(met.mapInArrow(_verifier(words, least), "a long, b long"), "links")

    def near(other: str):
        return F.least("n", other) >= F.lit(least) * F.greatest("n", other) - 1e-9

    pair = [F.least("node", "pn").alias("a"), F.greatest("node", "pn").alias("b")]
    lead = [F.min(F.struct(*([F.col("n").alias("o")] if k == 0 else []), F.xxhash64(F.lit(k), F.col("node")), "node", "n")).alias(f"p{k}") for k in range(pivots)]
    chosen = rows_.groupBy("bucket").agg(F.count("*").alias("k"), *lead).where("k > 1")
    # staged, as are the mixed buckets: a join of two plain exchanges is one whose hot keys Spark can split
    chosen = shared.staged(chosen.select("bucket", F.explode(F.array_distinct(F.array(*(F.struct(F.col(f"p{k}.node").alias("pn"), F.col(f"p{k}.n").alias("pk")) for k in range(pivots))))).alias("p")).select("bucket", "p.pn", "p.pk"), "pivots")
    first_pairs = rows_.join(chosen, "bucket").where((F.col("node") != F.col("pn")) & near("pk")).select(*pair).distinct()
    first_pairs = shared.staged(first_pairs, "candidates")
    likely = plausible(first_pairs)
    links = compared(likely)
    found = shared.staged(components(links), "classes")
    here = rows_.join(found, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("class"))
    mixed = here.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x != y").select("bucket")
    mixed = shared.staged(mixed, "mixed-buckets")
    # each node's hub: of itself and of those it was compared with, the one that most were compared with
    ends = likely.toDF("node", "hub").union(likely.select("b", "a"))
    degree = ends.groupBy("hub").agg(F.count("*").alias("k"))
    known = ends.join(degree, "hub").select("node", "k", "hub").union(degree.select("hub", "k", "hub"))
    hubs = known.groupBy("node").agg(F.max(F.struct("k", "hub"))["hub"].alias("hub"))
    open_ = here.join(mixed, "bucket").select("node", "n", "class").distinct().join(hubs, "node", "left")
    open_ = shared.staged(open_.withColumn("hub", F.coalesce("hub", "node")), "mixed-nodes")
    if not open_.isEmpty():
        shared_hubs = open_.groupBy("hub").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x != y").select("hub")
        wanted = open_.select("node").union(shared_hubs.select("hub")).distinct()
        texts = shared.staged(_texts_of(keyed, nodes, wanted), "mixed-texts")
        many = -(-n_bands * rows // 64)
        sign = [F.col("signs")[k].alias(f"s{k}") for k in range(many)]

        def between(tokens: DataFrame, what: str) -> DataFrame:
            """The tokens that occur in several classes, with the class that has most of a token's rows and their number."""
            each = tokens.groupBy("token", "class").agg(F.count("*").alias("k"), F.min("hub").alias("x"), F.max("hub").alias("y"))
            whole = each.groupBy("token").agg(F.count("*").alias("classes"), F.max(F.struct("k", "class"))["class"].alias("main"), F.sum("k").alias("seen"), F.min("x").alias("x"), F.max("y").alias("y"))
            return tokens.join(shared.staged(whole.where("classes > 1" + " and x != y" * (what == "mixed-tokens")).select("token", "main", "seen"), what), "token")

        # over: what a pair must share from its first common token on is the sum of both
        tokens = shared.staged(prefixes(texts, words, least).join(open_, "node").join(nodes.select("node", *sign), "node"), "prefixes")
        tokens = between(tokens, "mixed-tokens").withColumns({"left": F.col("n") - F.col("place"), "over": F.col("n") * F.lit(least / (1 + least)), "apart": F.lit(True)})
        # texts of one hub meet where they differ alike from most of its texts, so that what all of a large group have does not bring them together
        hub_texts = texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")).join(shared_hubs, "hub", "left_semi")
        with_hubs = texts.join(open_.select("node", "hub"), "node").join(hub_texts, "hub")
        unlike_hub = shared.staged(differences(with_hubs, words, least).join(open_.select("node", "n", "class"), "node"), "differences")
        heads = unlike_hub.groupBy("hub").agg(F.min(F.struct("over", "node", "class", "n")).alias("h")).select("hub", F.col("h.over").alias("p_over"), F.col("h.node").alias("p_node"), F.col("h.class").alias("p_class"), F.col("h.n").alias("p_n"))
        to_heads = unlike_hub.join(heads, "hub").where((F.col("class") != F.col("p_class")) & (F.col("over") + F.col("p_over") <= 1e-6))
        unlike_hub = between(unlike_hub.select("node", "hub", "n", "class", "over", F.explode("unlike").alias("token")), "mixed-differences")
        by_rarity = Window.partitionBy("node").orderBy("seen", "token")
        unlike_hub = unlike_hub.withColumns({"left": F.count("*").over(Window.partitionBy("node")) - F.row_number().over(by_rarity) + 1, "before": F.collect_list("token").over(by_rarity.rowsBetween(-HEAD, -1)), "apart": F.lit(False)})
        columns = ["token", "node", "n", "class", "hub", "left", "over", "before", "apart", "main", *(f"s{k}" for k in range(many))]
        tokens = shared.staged(tokens.select(*columns).union(unlike_hub.join(nodes.select("node", *sign), "node").select(*columns)), "tokens")
        other = tokens.select("token", *(F.col(c).alias(f"p_{c}") for c in columns[1:]))
        # of two classes one is not the one that has most rows of a token, so that the rows of a large class do not meet one another
        tokens = tokens.where("class != main")
        other_class = (F.col("p_class") == F.col("main")) | (F.col("class") < F.col("p_class"))
        ends = [F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")]
        # the first token they share stands early enough for all that they must share behind it
        enough = F.least("left", "p_left") >= F.col("over") + F.col("p_over") - 1e-6
        across_hubs = ~F.col("apart") | (F.col("hub") != F.col("p_hub"))
        # one bit of each register: equal by chance or for the same point; four standard deviations are allowed
        m, p = n_bands * rows, (1 + least) / 2
        unlike = F.bit_count(F.col("s0").bitwiseXOR(F.col("p_s0")))
        for k in range(1, many):
            unlike = unlike + F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"p_s{k}")))
        alike = unlike <= F.lit(m * (1 - p) + 4 * float(np.sqrt(m * p * (1 - p))))
        # a pair is made at its first common token; far into long prefixes, where `before` ends, perhaps again
        once = ~F.arrays_overlap("before", "p_before")
        rest = tokens.join(other, "token").where(other_class & across_hubs & near("p_n") & enough & alike & once).select(*ends)
        rest = rest.union(to_heads.select(*ends)).distinct().join(first_pairs, ["a", "b"], "left_anti")
        more = compared(plausible(shared.staged(rest, "candidates")))
        # links between classes join them
        of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()
        joined = shared.staged(components(ends), "classes").select(F.col("node").alias("component"), F.col("component").alias("whole"))
        old = found.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
        lone = joined.join(found.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("whole").alias("component"))
        found = shared.staged(old.union(lone), "classes")
    by_node = nodes.select("node", "rep").join(found, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    named = by_node.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("z"), "rep", "node")).alias("m")).select("component", F.col("m.rep").alias("class_id"), F.col("m.node").alias("class_node"))
    of_node = by_node.join(named, "component").select("node", "class_id", "class_node")
    met = signed.select("doc_id", "node", "n").join(of_node, "node", "left")
    own = F.col("n") == 0
    return met.select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        "node",
        F.lit(seed).alias("seed"),
        (~own).alias("has_words"),
        (own | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node")))).alias("kept"),
    )


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """docs with one row of each class of near duplicates, that of the smallest id; all columns and all rows without words stay.

    Of rows alike in id and text, one stays. See classes for the parameters and the rest."""
    found = shared.staged(classes(docs, id_column=id_column, text_column=text_column, **how), "classes-of-rows")
    first = found.select("seed").first()
    if first is None:
        return docs
    kept = found.where("kept").groupBy("doc_id", "node").agg(F.count("*").alias("lq_rows"), F.first("has_words").alias("lq_words")).withColumnsRenamed({"doc_id": "lq_id", "node": "lq_kept"})
    keyed = docs.withColumn("lq_node", _node(F.col(text_column), first[0]))
    met = keyed.join(kept, keyed[id_column].eqNullSafe(kept["lq_id"]) & (F.col("lq_node") == F.col("lq_kept")))
    alike = F.col("lq_words") & (F.col("lq_rows") > 1)
    return met.where(~alike).select(*docs.columns).union(met.where(alike).dropDuplicates(["lq_id", "lq_kept"]).select(*docs.columns))
