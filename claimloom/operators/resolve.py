"""Entity resolution: exact key, fuzzy, vector, new; then one closure over the batch.

The stages are joins. Fuzzy acceptance needs every one of five similarities at
0.95 or more, token overlap among them, which below twenty tokens means equal
token sets: so candidates meet on the sorted token set, and a Levenshtein bound
follows; no pair of names is compared that doesn't share it. The entity that is
asked is the one whose greatest similarity is greatest, though: candidates that
could be accepted also meet entities whose words are among theirs, or have all of
theirs, on the rarest word of the smaller side.

A sequential resolver would show each result to the next candidate. Here the
batch is resolved against the registry first, and what is left against itself
by connected components over shared keys and token sets; the head of a component
is its first candidate in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.batches import dealt
from claimloom.functions.normalize import slug_column, tokens_column
from claimloom.functions.similarity import index_score, jaro_winkler_column, levenshtein, token_jaccard, token_set_column, token_sort_column
from claimloom.operators.components import components, durable, kept
from claimloom.operators.vectors import Cells, k_nearest, placed_in_cells

FUZZY = 0.95
VECTOR = 0.88
NEIGHBOURS = 5
SHORT, SHORT_CAP = 4, 0.95
#: Pairs of names that a task compares: small rows, of which adaptive execution would put all in one task.
PAIRS_A_TASK = 25_000


def registry(entities: DataFrame, key) -> DataFrame:
    """(entity_type, key, entity_id): every name and alias of entities (id, label, name, canonical_name, aliases).

    The last entity of a key has it: by seq, where entities have that column, then by id.
    """
    order = F.struct(F.col("seq") if "seq" in entities.columns else F.lit(0).alias("seq"), F.col("id").alias("entity_id"))
    names = F.explode(F.array_distinct(F.concat(F.array("name", "canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("written")
    keyed = entities.select(F.col("label").alias("entity_type"), order.alias("last"), names).where("written is not null")
    keyed = keyed.withColumn("key", key(F.col("written"), F.col("entity_type"))).where("key <> ''")
    return keyed.groupBy("entity_type", "key").agg(F.max("last").alias("last")).select("entity_type", "key", F.col("last.entity_id").alias("entity_id"))


def exact(candidates: DataFrame, index: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Candidates (cand_id, entity_type, keys array) with matched entity_id: of the first key that is in the index and not blocked.

    blocked: (cand_id, entity_id) pairs that may not merge.
    """
    keyed = candidates.select("cand_id", F.col("entity_type").alias("t"), F.posexplode("keys").alias("at", "k")).where("k <> ''")
    hits = keyed.join(index, (F.col("t") == F.col("entity_type")) & (F.col("k") == F.col("key"))).select("cand_id", "at", "k", "entity_id")
    if blocked is not None:
        hits = hits.join(blocked.select(F.col("cand_id").alias("b"), F.col("entity_id").alias("e")), (F.col("cand_id") == F.col("b")) & (F.col("entity_id") == F.col("e")), "left_anti")
    return hits.groupBy("cand_id").agg(F.min(F.struct("at", "k", "entity_id")).alias("m")).select("cand_id", F.col("m.entity_id").alias("entity_id"), F.col("m.k").alias("key"))


def five_scores(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with the five similarities of two keys, their greatest (composite) and least (minimum)."""
    cap = lambda c: F.when(F.least(F.length(a), F.length(b)) < SHORT, F.least(c, F.lit(SHORT_CAP))).otherwise(c)
    x, y = F.col(a), F.col(b)
    scored = (
        pairs.withColumn("levenshtein", cap(levenshtein(x, y)))
        .withColumn("jaccard", cap(token_jaccard(tokens_column(x), tokens_column(y))))
        .withColumn("jaro_winkler", cap(jaro_winkler_column(x, y)))
        .withColumn("token_sort", cap(token_sort_column(x, y)))
        .withColumn("token_set", cap(token_set_column(x, y)))
    )
    five = ["levenshtein", "jaccard", "jaro_winkler", "token_sort", "token_set"]
    return scored.withColumn("composite", F.greatest(*five)).withColumn("minimum", F.least(*five))


def fuzzy(candidates: DataFrame, index: DataFrame, threshold: float = FUZZY, blocked: DataFrame | None = None) -> DataFrame:
    """Candidates (cand_id, entity_type, key) with the entity whose greatest similarity is best, if its least one is at the threshold or above.

    Ties go to the least entity id. Blocked entities don't take part. With seq and since, only what is older than the candidate does. Token sets of twenty and more may differ by
    one token and still pass; those meet on the set without each one of its tokens.
    """
    def blocks(df: DataFrame) -> DataFrame:
        found = tokens_column(F.col("key"))
        whole = F.array_join(found, " ")
        less = F.when(F.size(found) >= 19, F.transform(found, lambda t: F.concat(F.lit("-"), F.array_join(F.array_remove(found, t), " ")))).otherwise(F.array().cast("array<string>"))
        spread = F.array_union(F.array(whole), F.when(F.size(found) >= 19, F.array_union(less, F.array(F.concat(F.lit("-"), whole)))).otherwise(less))
        return df.where(F.size(found) > 0).withColumn("block", F.explode(spread))

    seq = F.col("seq") if "seq" in candidates.columns else F.lit(None).cast("long")
    since = F.col("since") if "since" in index.columns else F.lit(None).cast("long")
    candidates, index = candidates.withColumn("seq", seq), index.withColumn("since", since)
    older = F.col("since").isNull() | (F.col("since") < F.col("seq"))
    mine = blocks(candidates.select("cand_id", F.col("entity_type").alias("t"), "key", "seq")).withColumnRenamed("key", "a")
    theirs = blocks(index).select("entity_type", "entity_id", F.col("key").alias("b"), F.col("block").alias("other"), "since")
    pairs = mine.join(theirs, (F.col("t") == F.col("entity_type")) & (F.col("block") == F.col("other")) & older).select("cand_id", "a", "b", "entity_id").distinct()
    pairs = pairs.where(levenshtein(F.col("a"), F.col("b")) >= threshold)
    if blocked is not None:
        pairs = pairs.join(blocked.select(F.col("cand_id").alias("x"), F.col("entity_id").alias("e")), (F.col("cand_id") == F.col("x")) & (F.col("entity_id") == F.col("e")), "left_anti")
    good = durable(five_scores(pairs).where(F.col("minimum") >= threshold).select("cand_id", "a", "b", "entity_id", "composite", "minimum"))
    # who else could have a greatest similarity as great: equal token sets, or all words of one among the other's
    able = good.select("cand_id", "a").distinct()
    rivals = mine.join(able.select(F.col("cand_id").alias("able")), F.col("cand_id") == F.col("able"), "left_semi").join(theirs, (F.col("t") == F.col("entity_type")) & (F.col("block") == F.col("other")) & older).select("cand_id", "a", "b", "entity_id")
    rivals = rivals.unionByName(nested(candidates.join(able.select(F.col("cand_id").alias("able")), F.col("cand_id") == F.col("able"), "left_semi"), index)).distinct()
    if blocked is not None:
        rivals = rivals.join(blocked.select(F.col("cand_id").alias("x"), F.col("entity_id").alias("e")), (F.col("cand_id") == F.col("x")) & (F.col("entity_id") == F.col("e")), "left_anti")
    scored = five_scores(dealt(kept(rivals), "cand_id", PAIRS_A_TASK)).select("cand_id", "entity_id", "composite", "minimum")
    best = scored.groupBy("cand_id").agg(F.min(F.struct((-F.col("composite")).alias("m"), "entity_id", (-F.col("minimum")).alias("n"))).alias("best"))
    return best.select("cand_id", F.col("best.entity_id").alias("entity_id"), (-F.col("best.n")).alias("similarity")).where(F.col("similarity") >= threshold)


def nested(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """(cand_id, a, b, entity_id) of a candidate's key and an entity's, all words of one being among the other's."""
    def word_rows(df: DataFrame) -> DataFrame:
        return df.withColumn("words", F.array_distinct(F.filter(F.split("key", " "), lambda w: w != ""))).where(F.size("words") > 0)

    # the first time that an entity has a name counts
    since = F.col("since") if "since" in index.columns else F.lit(None).cast("long")
    seq = F.col("seq") if "seq" in candidates.columns else F.lit(None).cast("long")
    older = F.col("since").isNull() | (F.col("since") < F.col("seq"))
    candidates, index = candidates.withColumn("seq", seq), index.withColumn("since", since)
    theirs = word_rows(index.select("entity_type", "entity_id", "key", "since")).select("entity_type", "entity_id", F.col("key").alias("b"), F.col("words").alias("b_words"), "since")
    spread = theirs.withColumn("word", F.explode("b_words"))
    often = spread.groupBy("entity_type", "word").agg(F.count("*").alias("n")).withColumnsRenamed({"entity_type": "n_type", "word": "n_word"})
    counted = (F.col("entity_type") == F.col("n_type")) & (F.col("word") == F.col("n_word"))
    # an entity stands at its rarest word, where a candidate with all its words finds it
    rare = spread.join(often, counted).groupBy("entity_type", "entity_id", "b", "b_words", "since").agg(F.min(F.struct("n", "word")).alias("rarest")).select("entity_type", "entity_id", "b", "b_words", "since", F.col("rarest.word").alias("word"))
    mine = word_rows(candidates.select("cand_id", F.col("entity_type").alias("t"), "key", "seq")).select("cand_id", "t", "seq", F.col("key").alias("a"), F.col("words").alias("a_words"))
    own = mine.withColumn("w", F.explode("a_words"))
    within = own.join(rare, (F.col("t") == F.col("entity_type")) & (F.col("w") == F.col("word"))).where((F.size(F.array_except("b_words", "a_words")) == 0) & older)
    # and a candidate asks at its own rarest word for entities that have all its words; a word that no entity has ends the search
    asked = own.join(often, (F.col("t") == F.col("n_type")) & (F.col("w") == F.col("n_word")), "left").groupBy("cand_id", "t", "seq", "a", "a_words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")).alias("rarest")).select("cand_id", "t", "seq", "a", "a_words", F.col("rarest.w").alias("w"))
    beyond = asked.join(spread, (F.col("t") == F.col("entity_type")) & (F.col("w") == F.col("word"))).where((F.size(F.array_except("a_words", "b_words")) == 0) & older)
    columns = ["cand_id", "a", "b", "entity_id"]
    return within.select(*columns).unionByName(beyond.select(*columns))


def nearest(candidates: DataFrame, entities: DataFrame | Cells, k: int = NEIGHBOURS, threshold: float = VECTOR, excluded: DataFrame | None = None) -> DataFrame:
    """Candidates (cand_id, vector) with the best of their k nearest entities (entity_id, vector) that isn't excluded, at the threshold or above.

    Where both have entity_type, searches are within types. Exact, by cells;
    entities may be given in cells already. score = (1 + cosine) / 2; ties go to
    the least entity id. Vectors that are null, zero or of another length than
    most match nothing.
    """
    cells = entities if isinstance(entities, Cells) else placed_in_cells(entities)
    top = k_nearest(candidates, cells, k, 2 * threshold - 1)
    if excluded is not None:
        top = top.join(excluded.select(F.col("cand_id").alias("x"), F.col("entity_id").alias("e")), (F.col("cand_id") == F.col("x")) & (F.col("entity_id") == F.col("e")), "left_anti")
    best = top.groupBy("cand_id").agg(F.min(F.struct("place", "entity_id", "cosine")).alias("m"))
    return best.select("cand_id", F.col("m.entity_id").alias("entity_id"), index_score(F.col("m.cosine")).alias("score")).where(F.col("score") >= threshold)


def resolve(candidates: DataFrame, index: DataFrame, key, blocked: DataFrame | None = None, vectors: DataFrame | None = None, entity_vectors: DataFrame | None = None, threshold: float = VECTOR) -> DataFrame:
    """Every candidate (cand_id, seq, entity_type, name, aliases) with its entity_id and the method: exact, fuzzy, embedding or new.

    vectors (cand_id, vector) and entity_vectors (entity_id, entity_type,
    vector): with both, what names leave open goes to the nearest entity of its
    type, at the threshold or above. New ones are joined to each other over shared keys and token sets of their
    type; an entity's id is its type and the slug of its first candidate's name.
    """
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    spread = candidates.select("cand_id", "seq", "entity_type", "name", F.posexplode(names).alias("at", "written"))
    keyed = spread.withColumn("k", key(F.col("written"), F.col("entity_type")))
    cands = keyed.groupBy("cand_id", "seq", "entity_type", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "k"))), lambda x: x["k"]).alias("keys"))
    # keys and similarities are Python's work: what they make is kept, for it is read again and again
    cands, index = kept(cands.withColumn("key", F.get("keys", F.lit(0)))), kept(index)
    hit = exact(cands, index, blocked).select(F.col("cand_id").alias("e_id"), F.col("entity_id").alias("exact_id"))
    near = fuzzy(cands.select("cand_id", "entity_type", "key").where("key <> ''"), index, blocked=blocked).select(F.col("cand_id").alias("f_id"), F.col("entity_id").alias("fuzzy_id"), "similarity")
    placed = cands.join(hit, F.col("cand_id") == F.col("e_id"), "left").join(near, F.col("cand_id") == F.col("f_id"), "left").drop("e_id", "f_id")
    placed = kept(placed)
    if vectors is not None and entity_vectors is not None:
        open_ = placed.where("exact_id is null and fuzzy_id is null").select(F.col("cand_id").alias("o_id"), "entity_type")
        asked = vectors.join(open_, F.col("cand_id") == F.col("o_id"))
        met = nearest(asked.select("cand_id", "entity_type", "vector"), entity_vectors.select("entity_id", "entity_type", "vector"), threshold=threshold, excluded=blocked)
        placed = kept(placed.join(met.select(F.col("cand_id").alias("v_id"), F.col("entity_id").alias("vector_id"), F.col("score")), F.col("cand_id") == F.col("v_id"), "left").drop("v_id"))
    else:
        placed = placed.withColumn("vector_id", F.lit(None).cast(dict(index.dtypes)["entity_id"])).withColumn("score", F.lit(None).cast("double"))
    fresh = placed.where("exact_id is null and fuzzy_id is null and vector_id is null")
    blocks = fresh.select("cand_id", "seq", "entity_type", F.explode(F.array_union(F.transform("keys", lambda k: F.concat(F.lit("k:"), k)), F.array(F.concat(F.lit("t:"), F.array_join(tokens_column(F.col("key")), " "))))).alias("block")).where("length(block) > 2")
    # each member of a block is tied to the block's first: no pairs within a block
    heads = blocks.groupBy("entity_type", "block").agg(F.min("seq").alias("head"))
    ties = blocks.join(heads.withColumnsRenamed({"entity_type": "ht", "block": "hb"}), (F.col("entity_type") == F.col("ht")) & (F.col("block") == F.col("hb"))).where("seq <> head").select(F.col("seq").alias("a"), F.col("head").alias("b")).distinct()
    roots = components(ties)
    grouped = fresh.join(roots, F.col("seq") == F.col("node"), "left").withColumn("root", F.coalesce("root", "seq"))
    first = grouped.groupBy("root").agg(F.min_by("name", "seq").alias("first_name"), F.min_by("entity_type", "seq").alias("first_type"), F.min("seq").alias("first_seq")).withColumn("new_id", F.concat_ws(":", F.lower("first_type"), slug_column(F.col("first_name")))).withColumnRenamed("root", "top")
    made = grouped.join(first, F.col("root") == F.col("top")).select(F.col("cand_id").alias("n_id"), "new_id", (F.col("seq") == F.col("first_seq")).alias("is_first"))
    joined = placed.join(made, F.col("cand_id") == F.col("n_id"), "left")
    method = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("fuzzy_id").isNotNull(), "fuzzy").when(F.col("vector_id").isNotNull(), "embedding").when(F.col("is_first"), "new").otherwise("exact")
    return joined.select("cand_id", "entity_type", "name", "key", F.coalesce("exact_id", "fuzzy_id", "vector_id", "new_id").alias("entity_id"), method.alias("method"), F.round(F.coalesce("similarity", "score"), 3).alias("similarity"))


def blocked_by_neighbours(cands: DataFrame, neighbours: DataFrame, index: DataFrame) -> DataFrame:
    """(cand_id, entity_id) that may not merge: the entity has the key of a neighbour of the same type in the candidate's article.

    cands: cand_id, article_id, entity_type, key; neighbours: neighbour_keys() rows.
    """
    near = neighbours.select(F.col("article_id").alias("na"), F.col("entity_type").alias("nt"), "k", F.explode("neighbours").alias("n"))
    cands = cands.select("cand_id", "article_id", "entity_type", "key")
    met = cands.join(near, (F.col("article_id") == F.col("na")) & (F.col("entity_type") == F.col("nt")) & (F.col("key") == F.col("k")))
    of = met.withColumn("n_type", F.substring_index("n", ":", 1)).withColumn("n_key", F.expr("substr(n, instr(n, ':') + 1)")).where("n_type = entity_type").select("cand_id", "n_type", "n_key")
    known = index.select(F.col("entity_type").alias("i_type"), F.col("key").alias("i_key"), "entity_id")
    return of.join(known, (F.col("n_type") == F.col("i_type")) & (F.col("n_key") == F.col("i_key"))).select("cand_id", "entity_id").distinct()


def blocked_by_graph(cands: DataFrame, names: DataFrame, edges: DataFrame) -> DataFrame:
    """(cand_id, entity_id) that may not merge: the entity has a live domain relation with a node of the candidate's name, or that begins with it and a space.

    cands: cand_id, key; names: node_id, key; edges: undirected live (a, b).
    """
    whole = names.select("node_id", F.col("key").alias("probe"), F.lit(True).alias("whole"))
    # every prefix of a name that ends before a space, of four characters or more, is a probe
    words = F.split("key", " ")
    heads = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    prefixes = names.where(F.instr("key", " ") > 0).select("node_id", F.explode(heads).alias("probe"), F.lit(False).alias("whole")).where("length(probe) >= 4")
    found = cands.join(whole.unionByName(prefixes), F.col("key") == F.col("probe")).select("cand_id", "node_id")
    return found.join(edges, F.col("node_id") == F.col("a")).select("cand_id", F.col("b").alias("entity_id")).distinct()


def merged_entities(resolved: DataFrame, mentions: DataFrame, key, most: int = 5) -> DataFrame:
    """Entities of a batch: first name, aliases without repeated keys, strongest status, up to five distinct descriptions.

    resolved: cand_id, entity_id; mentions: cand_id, seq, entity_type, name, evidence_status, description.
    """
    rank = F.when(F.col("evidence_status") == "stated", 2).when(F.col("evidence_status") == "attributed", 1).otherwise(0)
    rows = resolved.select(F.col("cand_id").alias("c"), "entity_id").join(mentions, F.col("c") == F.col("cand_id")).withColumn("k", key(F.col("name"), F.col("entity_type"))).withColumn("rank", rank)
    # one row per entity and key first, so that a name that a third of all mentions use is one row after the partial aggregation
    by_key = rows.groupBy("entity_id", "entity_type", "k").agg(F.min(F.struct("seq", "name")).alias("n"), F.max("rank").alias("rank"))
    names = by_key.groupBy("entity_id", "entity_type").agg(F.transform(F.array_sort(F.collect_list("n")), lambda x: x["name"]).alias("names"), F.max("rank").alias("rank"))
    texts = rows.where("description is not null and description <> ''").groupBy("entity_id", "description").agg(F.min("seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("seq", "description"))
    pool = texts.withColumn("place", place).where(F.col("place") <= most).groupBy(F.col("entity_id").alias("d_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "description"))), lambda x: x["description"]).alias("descriptions"))
    status = F.when(F.col("rank") == 2, "stated").when(F.col("rank") == 1, "attributed").otherwise("unsure")
    return names.join(pool, F.col("entity_id") == F.col("d_id"), "left").select("entity_id", "entity_type", F.get("names", F.lit(0)).alias("canonical_name"), F.slice("names", 2, 1_000_000).alias("aliases"), status.alias("evidence_status"), F.coalesce("descriptions", F.array().cast("array<string>")).alias("descriptions"))

