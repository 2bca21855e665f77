"""Variant spellings of names typed by people: trie join within bounded edit distance, then token-order checks.

1. Each distinct value becomes a normal form: accents, case, titles, suffixes, nicknames in quotes, middle initials
   and legal forms are dropped, a surname-first form is turned round, known abbreviations are written out, and a short
   form of a given name is replaced by that name. Roles denote nobody and are left out.
   A given name that is one edit from just one known given name is also kept as that one.
2. The normal form is kept in several token orders - its rotations and the sorted one - so that permuted tokens meet,
   and tokens turned round even where they are misspelt.
3. Names are sharded: two names within one edit (insertion, deletion, substitution or exchange of neighbours) share a
   prefix and a suffix that leave out at most a third of the characters, so each name goes to the shards of its
   splits, as itself and as the longer partner. Shards with more than HOT names are split again by finer parts, down
   to names that differ in three characters at most.
4. In each shard the middles form a trie, which is walked once per name with a Levenshtein automaton (with exchange).
5. Pairs that differ in two known given names are relatives, not variants, and a very short token or name needs a known
   given name on one side (`relatives`). The others are links; labels flow along the links until nothing changes.
6. A chain of links can lead from one person to another: every spelling must be within two edits of the most frequent
   spelling of its cluster, in some order of tokens; those that are not form clusters of their own.
7. An initial joins the one name of that initial and surname, if there is one, or of a surname one edit away.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.multivalue import parse_values
from ..runtime import cut

#: Edits two spellings may differ by, splits per name at each level of sharding, names of a shard before it is split further.
DISTANCE, PARTS, HOT = 1, (3, 8, 64), 20_000
#: A name of a single token needs so many letters to be taken for a misspelling of another.
ALONE = 8
#: Letters of a given name, and of a surname after an initial, from which one edit in it is looked up.
MISSPELT = 5
#: Values of a cluster that are paired in one task.
BLOCK = 2000
#: Given names and short forms that are broadcast at most.
MOST_GIVEN = 100_000

# Fixed values of the normal form.
TITLES = frozenset("dr prof mr mrs ms miss sir dame rev hon the".split())
SUFFIXES = frozenset("phd md jr sr esq ii iii inc incorporated ltd limited llc llp lp plc corp corporation gmbh ag bv nv".split())
PARTICLES = frozenset("van von de da di del della la le el al bin ibn ter ten den der du dos das do zu zur".split())
ABBREVIATED = {
    "assn": "association",
    "assoc": "association",
    "centre": "center",
    "co": "company",
    "ctr": "center",
    "dept": "department",
    "fdn": "foundation",
    "found": "foundation",
    "grp": "group",
    "inst": "institute",
    "intl": "international",
    "natl": "national",
    "svc": "service",
    "tr": "trust",
    "univ": "university",
    "wtr": "water",
}
ROLE_WORDS = frozenset(
    """and author chief chair cofounder columnist contributing contributor correspondent critic director editor executive fellow
    founder freelance guest host journalist manager member photographer president producer professor publisher reporter
    senior speaker special staff student writer""".split()
)
_ROLE_PART = re.compile("|".join(sorted(ROLE_WORDS, key=len, reverse=True)))
_NICK = re.compile(r"(?<!\w)(?:\"[^\"]*\"|“[^”]*”|\([^)]*\)|'[^']*'|‘[^’]*’)(?!\w)")
_INITIALS = re.compile(r"(?:\w\.)+\w?$|\w$")


@dataclass(frozen=True)
class Form:
    """The normal form of a value; `keys` are empty for an initial with a surname, `initial` for what has none."""

    keys: tuple[str, ...]
    initial: str | None
    surname: str | None


def is_role(tokens: list[str]) -> bool:
    return bool(tokens) and all(not _ROLE_PART.sub("", t) for t in tokens)


def orders_of(tokens: list[str]) -> Iterator[list[str]]:
    """The token orders a name is kept in, as typed first."""
    for i in range(len(tokens)):
        yield tokens[i:] + tokens[:i]
    yield sorted(tokens)


def near_given(token: str, given: frozenset[str]) -> str | None:
    """The one known given name that is one edit from `token`, or None where there is none or several."""
    found = {t for t in _one_edit(token) if t in given}
    return found.pop() if len(found) == 1 else None


def _one_edit(word: str) -> Iterator[str]:
    for i in range(len(word) + 1):
        head, tail = word[:i], word[i:]
        if tail:
            yield head + tail[1:]
        if len(tail) > 1:
            yield head + tail[1] + tail[0] + tail[2:]
        for ch in ascii_lowercase:
            yield head + ch + tail
            if tail:
                yield head + ch + tail[1:]


def normal_form(value: str, short_forms: dict[str, str], given: frozenset[str]) -> Form | None:
    """None for roles and for values without letters."""
    text = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).casefold()
    text = _NICK.sub(" ", text) if len(text) > 2 and not _NICK.fullmatch(text.strip()) else text
    parts = [p.split() for p in text.split(",")]
    plain = lambda t: re.sub(r"[\W_]", "", t)
    if is_role([plain(t) for p in parts for t in p if plain(t)]):
        return None
    while len(parts) > 1 and all(plain(t) in SUFFIXES for t in parts[-1]):
        parts.pop()
    words = [t for p in ([*parts[1:], parts[0]] if len(parts) == 2 else parts) for t in p]
    tokens, initials = [], []
    for word in words:
        token = plain(word)
        if not token:
            continue
        if _INITIALS.fullmatch(word):
            initials.append(token[0])
            continue
        if not token.isalpha() and any(map(str.isalpha, token)):
            token = token.translate(str.maketrans("01", "ol"))
        tokens.append(ABBREVIATED.get(token, token))
    while len(tokens) > 1 and tokens[0] in TITLES:
        tokens.pop(0)
    while len(tokens) > 1 and tokens[-1] in SUFFIXES:
        tokens.pop()
    if len(tokens) > 2:
        tokens = [t for t in tokens if t != "of"] or tokens
    if not tokens or not any(map(str.isalpha, tokens)):
        return None
    core = [t for t in tokens if t not in PARTICLES]
    if initials and len(core) == 1:
        return Form((), initials[0], " ".join(sorted(tokens)))
    first = next((t for t in tokens if t in given or t in short_forms), tokens[0])
    orders = list(orders_of(tokens))
    name = short_forms.get(first)
    if name is None and first not in given and len(tokens) > 1 and len(first) >= MISSPELT:
        name = near_given(first, given)
    if name and name != first:
        orders += orders_of([name if t == first else t for t in tokens])
    first_letter = (short_forms.get(first) or first)[0]
    keys = tuple(dict.fromkeys(" ".join(o) for o in orders))
    rest = list(tokens)
    rest.remove(first)
    return Form(keys, first_letter if rest else None, " ".join(sorted(rest)) if rest else None)


def splits(name: str, parts: int) -> Iterator[tuple[int, int, int, int]]:
    """(shorter length, part, prefix length, suffix length) of the shards of `name`.

    Names of lengths n and n or n + 1 within one edit share a prefix p and a suffix q with p + q >= n - 2; the part
    that p falls into gives a prefix and a suffix both share.
    """
    for n in (len(name), len(name) - 1):
        if n < 3:
            continue
        edges = [k * (n - 2) // parts for k in range(parts + 1)]
        for k in range(parts):
            yield n, k, edges[k], n - 2 - edges[k + 1]


class Automaton:
    """Levenshtein automaton of a word with exchanges of neighbours: a state is the last two rows of distances."""

    def __init__(self, word: str, most: int) -> None:
        self.word, self.most = word, most

    def start(self) -> tuple:
        return (tuple(range(len(self.word) + 1)), None, "")

    def step(self, state: tuple, ch: str) -> tuple | None:
        row, before, last = state
        new = [row[0] + 1]
        for i, c in enumerate(self.word, 1):
            cost = min(new[-1] + 1, row[i] + 1, row[i - 1] + (c != ch))
            if before is not None and i > 1 and c == last and self.word[i - 2] == ch:
                cost = min(cost, before[i - 2] + 1)
            new.append(cost)
        # an exchange may still come from the row before, so both rows must be hopeless
        if min(new) > self.most and min(row) >= self.most:
            return None
        return (tuple(new), row, ch)

    def accepts(self, state: tuple) -> bool:
        return state[0][-1] <= self.most


def trie_pairs(names: list[str], most: int = DISTANCE) -> Iterator[tuple[str, str]]:
    """Every pair (a < b) of distinct `names` within `most` edits."""
    root: dict = {}
    for w in names:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = w
    for w in names:
        auto = Automaton(w, most)
        stack = [(root, auto.start())]
        while stack:
            node, state = stack.pop()
            found = node.get("")
            if found is not None and found > w and auto.accepts(state):
                yield w, found
            for ch, child in node.items():
                if ch and (after := auto.step(state, ch)) is not None:
                    stack.append((child, after))


def relatives(a: str, b: str, given: frozenset[str]) -> bool:
    """The two forms, one edit apart, denote different persons.

    So they do where they differ in nothing but two known given names. Tokens under four letters and single tokens
    under ALONE letters are too short for one edit to mean a slip, unless just one of the two is a known given name.
    """
    x, y = a.split(), b.split()
    only = sorted(set(x) - set(y)), sorted(set(y) - set(x))
    if len(only[0]) != 1 or len(only[1]) != 1:
        return False
    p, q = only[0][0], only[1][0]
    if p in given and q in given:
        return True
    short = max(len(p), len(q)) < 4 or len(x) == len(y) == 1 and max(len(p), len(q)) < ALONE
    return short and (p in given) == (q in given)


SHARDS = "shard long, prefix int, suffix int, name string"


def _shard(names: DataFrame, parts: int) -> DataFrame:
    """One row per name and shard; `names` has the columns (shard, name), the old shard being part of the new one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, prefix, suffix, source = [], [], [], []
            old = batch.column(0).to_pylist()
            for i, name in enumerate(batch.column(1).to_pylist()):
                for n, k, p, s in splits(name, parts):
                    tag = f"{old[i]}\t{parts}\t{n}\t{k}\t{name[:p]}\t{name[len(name) - s :]}"
                    shard.append(xxhash.xxh64_intdigest(tag.encode()) - (1 << 63))
                    prefix.append(p)
                    suffix.append(s)
                    source.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int64()), pa.array(prefix, pa.int32()), pa.array(suffix, pa.int32()), batch.column(1).take(pa.array(source, pa.int32()))],
                names=["shard", "prefix", "suffix", "name"],
            )

    return names.select("shard", "name").mapInArrow(run, SHARDS)


def trie_join(names: DataFrame, given: frozenset[str] = frozenset(), hot: int = HOT, differ=relatives, asked: DataFrame | None = None) -> DataFrame:
    """a, b: pairs of distinct `name`s within one edit that are not different by `differ` (see `relatives`).

    With `asked` (name), only shards that hold one of these names are looked at.
    """
    shards = _shard(names.select(F.lit(0).cast("long").alias("shard"), "name"), PARTS[0])
    if asked is not None:
        wanted = _shard(asked.select(F.lit(0).cast("long").alias("shard"), "name"), PARTS[0]).select("shard").distinct()
        shards = shards.join(wanted, "shard", "left_semi")
    done = None
    for parts in PARTS[1:]:
        crowded = cut(shards.groupBy("shard").count().where(F.col("count") > hot).select("shard"))  # few, and never collected
        if crowded.isEmpty():
            break
        cool = shards.join(crowded, "shard", "left_anti")
        done = cool if done is None else done.unionByName(cool)
        shards = _shard(shards.join(crowded, "shard", "left_semi"), parts)
    shards = shards if done is None else done.unionByName(shards)
    rows = shards.repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            at = batch.column(0).to_numpy()
            if not len(at):
                continue
            other = np.flatnonzero(at != at[-1])
            edge = int(other[-1]) + 1 if len(other) else 0
            if edge or rest and rest[-1].column(0)[-1].as_py() != at[0]:
                yield from join(pa.Table.from_batches([*rest, batch.slice(0, edge)]))
                rest = []
            rest.append(batch.slice(edge))
        if rest:
            yield from join(pa.Table.from_batches(rest))

    def join(table: pa.Table) -> Iterator[pa.RecordBatch]:
        at = table["shard"].to_numpy()
        edges = np.flatnonzero(np.diff(at)) + 1
        lows, highs = np.concatenate([[0], edges]), np.concatenate([edges, [len(at)]])
        many = highs - lows > 1
        left, right = [], []
        for low, high in zip(lows[many].tolist(), highs[many].tolist(), strict=True):
            group = table.slice(low, high - low)
            p, s = group["prefix"][0].as_py(), group["suffix"][0].as_py()
            whole = {n[p : len(n) - s]: n for n in set(group["name"].to_pylist())}
            for a, b in trie_pairs(list(whole)):
                a, b = whole[a], whole[b]
                if not differ(a, b, given):
                    left.append(min(a, b))
                    right.append(max(a, b))
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])

    return rows.mapInArrow(run, "a string, b string").distinct()


def components(links: DataFrame) -> DataFrame:
    """name, label: the smallest name each linked name can be reached from; labels stay distributed."""
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("name")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("name", "b"), "b").groupBy(F.col("a").alias("name")).agg(F.min("label").alias("near"))
        # a label is a name too: taking the label's own label halves the remaining way each round
        hop = labels.select(F.col("name").alias("label"), F.col("label").alias("hop"))
        new = labels.join(near, "name", "left").join(hop, "label", "left")
        new = cut(new.select("name", F.least("label", F.coalesce("near", "label"), F.coalesce("hop", "label")).alias("label"), F.col("label").alias("old")))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("name", "label")
        if not changed:
            return labels


FORMS = "value string, n long, name string, first boolean, initial string, surname string"


def within(a: str, b: str, most: int) -> bool:
    """Whether two names are within `most` edits."""
    if abs(len(a) - len(b)) > most:
        return False
    auto = Automaton(a, most)
    state = auto.start()
    for ch in b:
        state = auto.step(state, ch)
        if state is None:
            return False
    return auto.accepts(state)


def guarded(members: DataFrame, most: int = 2 * DISTANCE) -> DataFrame:
    """value, cluster of `members` (value, n, cluster, keys): values far from their cluster's main spelling set apart.

    The main spelling is the one of the most frequent value. Two spellings of one name, each `DISTANCE` edits from it
    at most, are within `most` edits of each other in some order of tokens. The values that are not form a cluster of
    their own, named after their own main spelling, and are looked at again until all are near theirs.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, main = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            fine = [not set(k).isdisjoint(m) or any(within(x, y, most) for x in k for y in m) for k, m in zip(mine, main, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine, pa.bool_())], names=["value", "near"])

    done, left = None, members
    while True:
        lead = left.groupBy("cluster").agg(F.max(F.struct("n", F.col("value").alias("v"), "keys")).alias("m"), F.count("*").alias("size"))
        several = left.join(lead.where("size > 1").select("cluster", F.col("m.keys").alias("main")), "cluster")
        far = cut(several.select("value", "keys", "main").mapInArrow(near, "value string, near boolean").where("not near").select("value"))
        if far.isEmpty():
            rest = left.select("value", "cluster")
            return rest if done is None else done.unionByName(rest)
        kept = left.join(far, "value", "left_anti").select("value", "cluster")
        done = kept if done is None else done.unionByName(kept)
        apart = left.join(far, "value", "left_semi")
        own = apart.groupBy("cluster").agg(F.max_by(F.element_at("keys", 1), F.struct("n", "value")).alias("own"))
        left = cut(apart.join(own, "cluster").select("value", "n", F.col("own").alias("cluster"), "keys"))


def name_clusters(df: DataFrame, column: str, given_names: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """value, cluster: every distinct value of the packed field `column` that denotes somebody, and whom.

    Null, empty and separator-only fields hold no value; repeated fields and values count once; other columns are
    ignored. `given_names` (given_name, short_form) is a small list; beyond MOST_GIVEN rows it is refused. An initial
    with a surname that fits several entities stays by itself.
    """
    spark = df.sparkSession
    pairs = given_names.select("given_name", "short_form").limit(MOST_GIVEN + 1).collect() if given_names is not None else []
    if len(pairs) > MOST_GIVEN:
        raise ValueError(f"more than {MOST_GIVEN} given names")
    fold = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x or "") if c.isalnum()).casefold()
    shared = spark.sparkContext.broadcast(({fold(r["short_form"]): fold(r["given_name"]) for r in pairs if r["short_form"] and r["given_name"]}, frozenset(fold(r["given_name"]) for r in pairs if r["given_name"])))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for x, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for v in {v for v, _ in parse_values(x)}:
                    found[v] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["value", "n"])

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short_forms, given = shared.value
        for batch in batches:
            out = []
            for v, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                form = normal_form(v, short_forms, given)
                if form is not None:
                    out += [(v, n, k, not i, form.initial, form.surname) for i, k in enumerate(form.keys or (None,))]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["value", "n", "name", "first", "initial", "surname"])

    fields = df.select(F.col(column).alias("field")).where("field is not null and field <> ''").groupBy("field").count()
    distinct = fields.mapInArrow(values, "value string, n long").groupBy("value").agg(F.sum("n").alias("n"))
    form = cut(distinct.mapInArrow(forms, FORMS))
    names = form.where("name is not null").select("name").distinct()
    known = shared.value[1] | frozenset(shared.value[0])
    near = trie_join(names, known, hot)
    own = form.where("first").select("value", F.col("name").alias("a")).join(form.where("not first").select("value", F.col("name").alias("b")), "value").select("a", "b").distinct()
    labels = components(near.unionByName(own))
    named = form.where("first and name is not null").join(labels, "name", "left").select("value", "initial", "surname", F.coalesce("label", "name").alias("cluster"))
    keys = form.where("name is not null").groupBy("value").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct(~F.col("first"), "name"))).alias("k"))
    members = cut(named.select("value", "cluster").join(keys, "value").select("value", "n", "cluster", F.col("k.name").alias("keys")))
    main = cut(named.drop("cluster").join(guarded(members), "value"))
    people = cut(main.where("initial is not null").groupBy("initial", "surname").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")))
    short = form.where("name is null").join(people, ["initial", "surname"], "left")
    misspelt = _misspelt_surnames(short.where("low is null"), people, hot)
    short = short.join(misspelt, ["initial", "surname"], "left").withColumns({"low": F.coalesce("low", "near_low"), "high": F.coalesce("high", "near_high")})
    alone = F.concat(F.col("initial"), F.lit(". "), F.col("surname"))
    fits = F.when(F.col("low").isNull(), alone).when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.concat(alone, F.lit(" / "), F.col("value")))
    return main.select("value", "cluster").unionByName(short.select("value", fits.alias("cluster")))


def _misspelt_surnames(unknown: DataFrame, people: DataFrame, hot: int) -> DataFrame:
    """initial, surname, near_low, near_high: the people one edit away from surnames after an initial that nobody has,
    where they are one person."""
    wanted = cut(unknown.where(F.length("surname") >= MISSPELT).select("initial", "surname").distinct())
    asked = wanted.select(F.col("surname").alias("name")).distinct()
    surnames = asked.union(people.where(F.length("surname") >= MISSPELT).select("surname")).distinct()
    pairs = trie_join(surnames, hot=hot, differ=lambda a, b, given: False, asked=asked)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = wanted.join(both, wanted["surname"] == both["a"]).select("initial", "surname", F.col("b").alias("other"))
    found = near.join(people.select("initial", F.col("surname").alias("other"), "low", "high"), ["initial", "other"])
    one = found.groupBy("initial", "surname").agg(F.min("low").alias("near_low"), F.max("high").alias("near_high"))
    return one.where("near_low = near_high")


def name_variants(df: DataFrame, column: str, given_names: DataFrame | None = None, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """name_a < name_b (by code points): the spellings of one person or organisation, as pairs.

    `name_clusters` is the form without pairs. Clusters of more than `block` values are dealt into blocks, and each
    pair of blocks meets by itself, so no cluster is paired in one task.
    """
    clusters = cut(name_clusters(df, column, given_names, hot))
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    dealt = clusters.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("value"), F.col("n").cast("bigint")).cast("int"))
    a = dealt.select("cluster", F.col("value").alias("name_a"), F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    b = dealt.select("cluster", F.col("value").alias("name_b"), F.col("part").alias("j"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return a.join(b, ["cluster", "i", "j"]).where("name_a < name_b").select("name_a", "name_b")
