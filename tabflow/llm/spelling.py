"""Spelling variants: words one edit apart, found by walking a relational trie, grouped under their common form.

The trie is a table of edges (node, letter, child), a node being the prefix that leads to it. The frontier is a table of
states (word, place, node, edits): level by level it is joined with the edges of that level. A state without an edit may
take a child by another letter than the word's own (a replaced letter) or skip a letter of the word (a deleted one); a
state with its edit made takes only the child by the word's next letter. An inserted letter is the other word's deleted
one, and of two words that differ by a replaced letter the one with the smaller letter finds the other, so each pair is
looked for once. A state ends where one word is left below its node: what is left of both words is compared directly, and
if equal they are neighbours. So the number of levels is that of the longest prefix that words share.

Near the root a trie branches most, and edits made there would lead everywhere. So words are entered twice, as they are and
reversed, and edits are made in the second half only: an edit in the first half of a word is one in the second half of its
reverse. Edges also carry which letters may follow and which lengths are left below, which ends most states before they are
written.

The frontier takes a job per level, so words longer than `TRIE` letters, of which language has hardly any, meet otherwise:
each gives a hash of itself without the letter at each place, two words with one letter replaced agree in one of these and
its place, and a shorter word is one of them. What meets is compared whole, so the result is exact for them, too.

Defined results: a null text has no words; a null id counts as empty text in the hash; runs and words may have any length;
repeated rows count as often as they occur; an empty table gives an empty one; of near words that are as frequent, the first
in code-point order is the form; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import drop_settled, passing, settle
from tabflow.runtime import col

#: Letters of a run.
LETTERS = r"A-Za-zÀ-ÿ"
#: Code points of a word at least, and its occurrences.
LENGTH, OCCURRENCES = 7, 2
#: How much more frequent a form is.
RATIO = 10
#: Levels of the trie that are built at once.
LEVELS = 16
#: Letters of the words in the trie at most; those one longer are in it as well, for the pairs across this bound.
TRIE = 40
#: What a path begins and ends with: read forward or backward, end of the word. The end sorts before all letters.
FORWARD, BACKWARD, END = ">", "<", "$"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", deleted: int | None = 31) -> DataFrame:
    """(word, n): words of enough letters and occurrences.

    deleted: a run loses a letter if this number divides the crc32 of its id and letters; None leaves all as they are.
    """
    runs = F.regexp_extract_all(col(text), F.lit(f"[{LETTERS}]{{{LENGTH},}}"), F.lit(0))
    run = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    run = run.select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("word"))
    if deleted:
        hashed = run.withColumn("h", F.crc32(F.concat_ws(":", "id", "word").cast("binary")))
        at = "cast(h % length(word) AS int)"
        cut = F.expr(f"concat(substring(word, 1, {at}), substring(word, {at} + 2))")
        run = hashed.select(F.when(F.col("h") % deleted == 0, cut).otherwise(F.col("word")).alias("word"))
    counted = run.filter(F.length("word") >= LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= OCCURRENCES)


def _letter(path: str, at: str) -> str:
    """SQL of a path's letter at a place from 0; empty behind the end."""
    return f"substring({path}, {at} + 1, 1)"


def _bit(of: str) -> str:
    """SQL of a letter's bit in a mask; several letters may share one, so masks only ever rule out."""
    return f"shiftleft(1L, ascii({of}) % 64)"


def paths(counted: DataFrame) -> DataFrame:
    """(id, path, n, first): each word forward and backward, and the least depth at which it may be edited.

    The numbers hold once the frame is written down.
    """
    n = "length(word)"
    forward = f"struct(concat('{FORWARD}', word, '{END}') AS path, n, 1 + {n} div 2 AS first)"
    backward = f"struct(concat('{BACKWARD}', reverse(word), '{END}') AS path, n, 1 + {n} - {n} div 2 AS first)"
    return counted.selectExpr(f"inline(array({forward}, {backward}))").selectExpr(
        "monotonically_increasing_id() AS id", "path", "n", "int(first) AS first"
    )


def edges(active: DataFrame, low: int) -> DataFrame:
    """Edges from nodes of `LEVELS` depths, from `low` on, of the trie of some paths.

    (depth, node, letter, child, n_paths, only, follow, rest): paths below the child, one of them, the letters that
    follow it and the lengths that are left below it, both as masks.
    """
    deep = f"least(length(path) - 1, {low + LEVELS - 1})"
    steps = active.filter(f"length(path) > {low}").selectExpr("id", "path", f"explode(sequence({low}, {deep})) AS depth")
    children = steps.selectExpr(
        "depth", "substring(path, 1, depth + 1) AS child", "id AS only",
        f"{_bit(_letter('path', 'depth + 1'))} AS follow", "shiftleft(1L, least(length(path) - depth - 1, 63)) AS rest",
    )
    found = children.groupBy("depth", "child").agg(
        F.count("*").alias("n_paths"), F.max("only").alias("only"), F.bit_or("follow").alias("follow"), F.bit_or("rest").alias("rest")
    )
    return found.selectExpr(
        "depth", "substring(child, 1, depth) AS node", f"{_letter('child', 'depth')} AS letter", "child", "n_paths", "only", "follow", "rest"
    )


def _step(states: DataFrame, level: DataFrame) -> DataFrame:
    """The frontier one level on: (path, n, at, edited, node, n_paths, only), the edit made in all of them.

    states: (path, n, at, edited, node), `at` the place of the path's next letter.
    """
    here, after = _letter("path", "at"), _letter("path", "at + 1")
    moves = [
        ("edited AND letter = here", "at + 1"),
        ("NOT edited AND letter > here", "at + 1"),
        # Of a letter that stands twice the last goes, so that a pair is found in one way.
        ("NOT edited AND letter = after AND here <> after", "at + 2"),
    ]
    to = ", ".join(f"if({when}, {place}, NULL)" for when, place in moves)
    any_move = " OR ".join(f"({when})" for when, _ in moves)
    taken = (
        states.selectExpr("path", "n", "at", "edited", "node", f"{here} AS here", f"{after} AS after")
        .join(level, "node")
        .filter(any_move)
        .selectExpr("path", "n", "child AS node", "n_paths", "only", "follow", "rest", f"explode(filter(array({to}), x -> x IS NOT NULL)) AS at")
    )
    hopeful = f"follow & {_bit(_letter('path', 'at'))} <> 0 AND rest & shiftleft(1L, least(length(path) - at, 63)) <> 0"
    return taken.filter(hopeful).selectExpr("path", "n", "at", "true AS edited", "node", "n_paths", "only")


def _long_neighbours(counted: DataFrame) -> DataFrame:
    """(word, n, near, near_n): pairs of long words, each at least once; groups that meet are as large as the alphabet."""
    known = settle(counted.selectExpr("xxhash64(word) AS id", "length(word) AS size", "word", "n"), "long")
    places = known.selectExpr("id", "size", "word", "explode(sequence(0, size - 1)) AS at")
    cut = settle(places.selectExpr("id", "size", "at", "xxhash64(concat(substring(word, 1, at), substring(word, at + 2))) AS key"), "cut")
    other = cut.selectExpr("id AS other", "size", "at", "key")
    replaced = cut.join(other, ["size", "at", "key"]).filter("id < other").select("id", "other")
    shorter = known.selectExpr("id AS other", "size + 1 AS size", "id AS key")
    deleted = cut.join(shorter, ["size", "key"]).select("id", "other")
    met = replaced.union(deleted).distinct()
    near = known.selectExpr("id AS other", "word AS near", "n AS near_n")
    pairs = met.join(known.select("id", "word", "n"), "id").join(near, "other")
    return pairs.filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def neighbours(counted: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words one edit apart, in both orders, each once."""
    entered = active = settle(paths(counted.filter(F.length("word") <= TRIE + 1)), "paths")
    low, found, states = 1 + LENGTH // 2, [], None
    while True:
        trie = settle(edges(active, low).repartitionByRange("depth", "node").sortWithinPartitions("depth", "node"), "trie")
        top = low + LEVELS - 1
        deepest = trie.filter("n_paths > 1").agg(F.max("depth")).first()[0]
        # Nodes of one path lead nowhere: the last level is that below the deepest node of several.
        for depth in range(low, min(top, max(low, (deepest or 0) + 1)) + 1):
            fresh = active.filter(f"first <= {depth} AND length(path) - 1 > {depth}").selectExpr(
                "path", "n", f"{depth} AS at", "false AS edited", f"substring(path, 1, {depth}) AS node"
            )
            frontier = fresh if states is None else fresh.unionByName(states)
            step = settle(_step(frontier, trie.filter(f"depth = {depth}")), "frontier")
            found.append(step.filter("n_paths = 1").select("path", "n", "at", "node", "only"))
            states = step.filter("n_paths > 1").select("path", "n", "at", "edited", "node")
        if deepest != top:
            break
        shared = trie.filter(f"n_paths > 1 AND depth = {top}").select(F.col("child").alias("stem"))
        active = settle(active.join(shared, F.substring("path", 1, top + 1) == F.col("stem"), "left_semi"), "paths")
        low = top + 1
    # Where one path is left, what is left of both is compared.
    met = reduce(DataFrame.union, found).join(entered.selectExpr("id AS only", "path AS other", "n AS near_n"), "only")
    met = met.filter("substring(path, at + 1) = substring(other, length(node) + 1)")
    spelled = lambda p: F.expr(f"if(startswith({p}, '{BACKWARD}'), reverse(substring({p}, 2, length({p}) - 2)), substring({p}, 2, length({p}) - 2))")
    pairs = met.select(spelled("path").alias("word"), "n", spelled("other").alias("near"), "near_n")
    pairs = pairs.union(_long_neighbours(counted.filter(F.length("word") >= TRIE)))
    both = pairs.union(pairs.select("near", "near_n", "word", "n"))
    return settle(both.distinct(), "neighbours")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last; a form is more frequent than its word, so there is one.

    Each round follows the form of the form, so rounds are the logarithm of the longest chain.
    """
    state = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = state.select(F.col("word").alias("via"), F.col("root").alias("next"))
        step = state.join(onward, state["root"] == onward["via"], "left")
        step = settle(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_settled(state)
        if step.filter("moved").limit(1).count() == 0:
            return step.select("word", "root")
        state = step


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", deleted: int | None = 31) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word with its number of near words and the form it is a variant of."""
    counted = settle(words(docs, id_col, text, deleted), "words")
    with passing(docs.sparkSession) as kept:
        pairs = neighbours(counted)
        kept.append(pairs)
    best = pairs.groupBy("word").agg(
        F.first("n").alias("n"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    frequent = -F.col("best.less") >= RATIO * F.col("n")
    stated = settle(
        best.select("word", "n_near", F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")),
        "forms",
    )
    drop_settled(pairs)
    last = roots(stated.filter("form IS NOT NULL").select("word", "form"))
    found = counted.join(stated, "word", "left").join(last, "word", "left")
    return found.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"
    )
