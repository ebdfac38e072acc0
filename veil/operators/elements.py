"""Page elements: repeated labels, card context, stable ids, selection, signatures, resolution after a change."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veil import rules
from veil.functions.detect import find_spans
from veil.functions.text import let, one_space, same_name, slugify, strip_volatile
from veil.plans.ordered import numbered, running_totals, seq_bucket, top_per_key
from veil.session import settled
from veil.sources.html import attr, card_context, is_editable


def label_key(label: Column) -> Column:
    return one_space(F.lower(label))


def with_duplicates(elements: DataFrame, page: list[str], label: str = "label") -> DataFrame:
    """Adds ``duplicated``: the label occurs on more than one element of the page. The counts are formed by a combining
    aggregate and joined back, so a page or label with very many rows is not windowed in one task."""
    rows = elements.withColumn("__label", label_key(F.col(label)))
    counts = rows.groupBy(*page, "__label").agg((F.count("*") > 1).alias("duplicated"))
    return rows.join(counts, [*page, "__label"]).drop("__label")


def with_context(elements: DataFrame) -> DataFrame:
    """Adds ``context`` to elements whose label is repeated."""
    context = card_context(F.col("node"), F.col("nodes"), F.col("label"))
    return elements.withColumn("context", F.when(F.col("duplicated"), F.nullif(context, F.lit(""))))


def base_id(identifier: Column, text: Column) -> Column:
    """``el_`` + slug of the id attribute, else of the label without volatile parts; null when neither gives one
    or the label itself holds personal data."""
    slug = slugify(strip_volatile(text))
    by_text = F.when((text == "") | (F.size(find_spans(text)) > 0) | (slug == ""), F.lit(None)).otherwise(F.concat(F.lit("el_"), slug))
    return F.when(identifier != "", F.concat(F.lit("el_"), slugify(identifier))).otherwise(by_text)


def naming_text(node: Column, label: Column) -> Column:
    """What an id may be made of: fields give their name, label or placeholder, never their value."""
    kind = F.lower(attr(node, "type"))
    button = kind.isin("submit", "button", "reset", "image")
    field = node["tag"].isin("textarea", "select") | ((node["tag"] == "input") & ~button) | is_editable(node)
    given = F.coalesce(*[F.nullif(attr(node, n), F.lit("")) for n in ("name", "aria-label", "placeholder")], F.lit(""))
    return F.when(field, F.trim(given)).otherwise(label)


#: A base that the page's counter could draw as well. Longer numbers are beyond any page.
COUNTED = "^el_[1-9][0-9]{0,8}$"


def assign_ids(elements: DataFrame, page: list[str], base: str = "base", pos: str = "pos") -> DataFrame:
    """Adds ``element_id``: in order of ``pos``, an element takes its base if it is free, else the counter's next free number.

    Only bases that look like a drawn id tie the two together. A page's first occurrences of such bases are few; they are folded in order
    in one row: number n is still free when fewer than n numbers outside the kept ones have been drawn. The m-th draw of the page is then
    the m-th number that no base keeps, and m is a running count that a page with very many elements spreads over tasks.
    """
    first = elements.filter(F.col(base).isNotNull()).groupBy(*page, base).agg(F.min(pos).alias("__first"))
    rows = elements.join(first, [*page, base], "left")
    leads = F.coalesce(F.col("__first") == F.col(pos), F.lit(False))
    rows = rows.withColumn("__sure", F.when(leads, 0).otherwise(1))
    rows = running_totals(rows, page, seq_bucket(F.col(pos)), [F.col(pos)], {"__s": F.col("__sure")})
    counted = rows.filter((F.col("__sure") == 0) & F.col(base).rlike(COUNTED))
    mark = F.struct(F.col(pos).cast("long").alias("pos"), F.substring(base, 4, 9).cast("long").alias("n"), F.col("__s").alias("s"))
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.array().cast("array<bigint>").alias("lost"))

    def step(acc: Column, x: Column) -> Column:
        free = x["n"] - F.size(F.filter(acc["kept"], lambda k: k <= x["n"]))
        loses = free <= x["s"] + F.size(acc["lost"])
        return F.struct(F.when(loses, acc["kept"]).otherwise(F.array_append(acc["kept"], x["n"])).alias("kept"),
                        F.when(loses, F.array_append(acc["lost"], x["pos"])).otherwise(acc["lost"]).alias("lost"))

    folded = counted.groupBy(*page).agg(F.sort_array(F.collect_list(mark)).alias("__marks"))
    folded = folded.select(*page, F.aggregate("__marks", start, step, lambda acc: F.struct(F.array_sort(acc["kept"]).alias("kept"), acc["lost"].alias("lost"))).alias("__f"))
    rows = rows.join(folded, page, "left")
    kept, lost = (F.coalesce(F.col(f"__f.{n}"), F.array().cast("array<bigint>")) for n in ("kept", "lost"))
    draws = (F.col("__sure") == 1) | F.array_contains(lost, F.col(pos).cast("long"))
    m = F.col("__s") + F.size(F.filter(lost, lambda p: p <= F.col(pos)))
    number = F.aggregate(kept, m, lambda x, k: F.when(k <= x, x + 1).otherwise(x))
    drawn = F.concat(F.lit("el_"), number.cast("string"))
    return rows.withColumn("element_id", F.when(draws, drawn).otherwise(F.col(base))).drop("__first", "__sure", "__s", "__f")


def top_elements(elements: DataFrame, page: list[str], k: int = rules.MAX_ELEMENTS, pos: str = "pos",
                 in_view: Column | None = None) -> DataFrame:
    """At most ``k`` elements per page: in view first, then controls, then links; all of a smaller page."""
    seen = F.lit(False) if in_view is None else in_view
    link = (F.col("tag") == "a") | (F.col("role") == "link")
    rank = F.when(seen, 0).when(~link, 1).otherwise(2)
    return top_per_key(elements, page, [rank, F.col(pos)], k)


#: Signatures are sums of control hash times base to the power of the control's place, modulo a prime, in two lanes.
SIGNATURE_PRIME, SIGNATURE_BASES = 2147483647, (1000003, 7368787)


def _power(base: int, exponent: Column) -> Column:
    """base ** exponent modulo the prime by squaring, for exponents under 2^31."""
    value, square = F.lit(1).cast("long"), base
    for bit in range(31):
        value = value * F.when(F.shiftright(exponent, bit).bitwiseAND(1) == 1, square).otherwise(1) % SIGNATURE_PRIME
        square = square * square % SIGNATURE_PRIME
    return value


def control_key() -> Column:
    return F.concat_ws("|", "tag", "element_id", F.left(F.trim("label"), F.lit(40)))


def order_hash(key: Column, place: Column) -> Column:
    """Hash of keys at places (from 0) as an aggregate. Sums in any order and of any parts give the same value, so tasks combine their
    own rows before the shuffle and no page is ever put in order in one row."""
    digest = F.md5(F.coalesce(key, F.lit("")).cast("binary"))
    lanes = [F.sum(F.conv(F.substring(digest, 1 + 7 * i, 7), 16, 10).cast("long") * _power(base, place.cast("long")) % SIGNATURE_PRIME) % SIGNATURE_PRIME
             for i, base in enumerate(SIGNATURE_BASES)]
    return lanes[0] * F.lit(1 << 31) + lanes[1]


def page_signature(elements: DataFrame, page: list[str], pos: str = "pos", key: Column | None = None) -> DataFrame:
    """Count of controls and an order-sensitive hash of the first 300; a changed value means a changed page."""
    key = control_key() if key is None else key
    counts = elements.groupBy(*page).agg(F.count("*").alias("n_controls"))
    rank = F.row_number().over(W.partitionBy(*page).orderBy(pos))
    head = elements.select(*page, key.alias("__key"), rank.alias("__rank")).filter(F.col("__rank") <= rules.SIGNATURE_CONTROLS)
    return counts.join(head.groupBy(*page).agg(order_hash(F.col("__key"), F.col("__rank") - 1).alias("hash")), page)


def changed_range(before: DataFrame, after: DataFrame, page: list[str], pos: str = "pos", key: Column | None = None,
                  widths: tuple[int, ...] = (4096, 64)) -> DataFrame:
    """Per page of either snapshot ``change`` (same, changed, added, removed) and the smallest range of controls that an edit must have
    replaced: places ``first`` to ``before_end`` became ``first`` to ``after_end`` (from 0, ends exclusive; null where nothing changed).

    Both snapshots are cut into nodes of ``widths`` controls, numbered from the front and from the back. A node is one hash; only the first
    node that differs is opened, and its controls alone meet in the end, so a long page with one edit costs a few rows after the first
    aggregate. A page without controls is on neither side. Controls are ordered by ``pos``, which must be unique in its page.
    """
    key = control_key() if key is None else key

    def side(elements: DataFrame) -> DataFrame:
        rows = numbered(elements.select(*page, pos, key.alias("__key")), page, seq_bucket(F.col(pos)), [F.col(pos)], "__at")
        rows = rows.join(elements.groupBy(*page).agg(F.count("*").alias("__n")), page)
        ways = F.array(F.struct(F.lit(0).alias("way"), (F.col("__at") - 1).alias("i")), F.struct(F.lit(1).alias("way"), (F.col("__n") - F.col("__at")).alias("i")))
        return settled(rows.select(*page, "__n", "__key", F.explode(ways).alias("w")).select(*page, "__n", "__key", "w.way", "w.i"))

    sides = [side(before), side(after)]
    opened, above = None, 0
    for width in (*widths, 1):
        levels = []
        for rows, name in zip(sides, ("__x", "__y")):
            if opened is not None:
                rows = rows.join(opened, [*page, "way"]).filter(F.floor(F.col("i") / above) == F.col("__node"))
            levels.append(rows.groupBy(*page, "way", F.floor(F.col("i") / width).alias("node")).agg(order_hash(F.col("__key"), F.col("i")).alias(name)))
        differ = levels[0].join(levels[1], [*page, "way", "node"], "full").filter(~F.col("__x").eqNullSafe(F.col("__y")))
        opened, above = settled(differ.groupBy(*page, "way").agg(F.min("node").alias("__node"))), width
    sizes = [rows.filter("way = 0 AND i = 0").select(*page, F.col("__n").alias(name)) for rows, name in zip(sides, ("__a", "__b"))]
    equal = opened.groupBy(*page).agg(*[F.max(F.when(F.col("way") == w, F.col("__node"))).alias(n) for w, n in ((0, "first"), (1, "__back"))])
    done = sizes[0].join(sizes[1], page, "full").join(equal, page, "left")
    back = F.least("__back", F.col("__a") - F.col("first"), F.col("__b") - F.col("first"))
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("first").isNull(), "same").otherwise("changed")
    return done.select(*page, change.alias("change"), "first", F.when(both, F.col("__a") - back).otherwise(F.coalesce("__a", F.lit(0))).alias("before_end"),
                       F.when(both, F.col("__b") - back).otherwise(F.coalesce("__b", F.lit(0))).alias("after_end"))


#: Names of up to FEW tokens meet at TOGETHER tokens at once.
FEW, TOGETHER = 6, 3


def _together(n: Column, tokens: Column, sizes: Column) -> Column:
    """Keys of a name of ``n`` <= FEW tokens (rarest first) for partners of each of ``sizes``: sizes of the pair and tokens that both must have."""
    ways = []
    for own in range(1, FEW + 1):
        for mate in range(1, FEW + 1):
            share = math.ceil((own + mate) * rules.SIMILARITY_MIN / (1 + rules.SIMILARITY_MIN) - 1e-6)
            if share > min(own, mate):
                continue
            k = min(share, TOGETHER)
            picks = F.array(*[F.concat_ws(" ", F.lit(f"{min(own, mate)}-{max(own, mate)}:"), *[F.get(tokens, i) for i in pick])
                              for pick in combinations(range(own - share + k), k)])
            ways.append(F.when((n == own) & F.array_contains(sizes, mate), picks).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*ways))


def similar_names(left: DataFrame, right: DataFrame, on: list[str], name: str = "name") -> DataFrame:
    """(on, name, name_2): distinct names of two tables that denote one control, joined on what similar names must share.

    A name meets those that begin with it whole: it offers itself, and the others their own beginnings of the lengths that occur among
    names with the same first 8 characters, so names that merely begin alike never meet. Jaccard >= 0.6 of n and m tokens implies s =
    ceil(0.375 (n + m)) shared ones, k <= s of them among the first n - s + k of each side in any one order of the tokens. Names of up to
    ``FEW`` tokens meet at k = ``TOGETHER`` of them at once (all s, if fewer), a key for each pair of sizes that occurs, so frequent words
    alone bring none together; longer ones meet at one of their rarest tokens (prefix filter), with enough tokens after the first shared
    one on both sides (positional filter). Copies of a name are compared once.
    """
    a = left.select(*on, F.col(name).alias("__name")).distinct()
    b = right.select(*on, F.col(name).alias("__name")).distinct()

    def words() -> Column:
        return F.array_distinct(F.filter(F.split("__name", " "), lambda t: t != ""))

    counts = a.unionByName(b).select(*on, F.explode(words()).alias("__t")).groupBy(*on, "__t").agg(F.count("*").alias("__f"))
    sizes = a.unionByName(b).select(F.size(words()).alias("n")).where(F.col("n").between(1, FEW)).agg(F.collect_set("n").alias("__sizes"))
    lead, least = F.left("__name", F.lit(rules.SIMILAR_PREFIX_MIN)), rules.SIMILAR_PREFIX_MIN
    lengths = a.unionByName(b).filter(F.length("__name") >= least).groupBy(*on, lead.alias("__lead")).agg(F.collect_set(F.length("__name")).alias("__lens"))

    def keys(names: DataFrame, own: str, other: str) -> DataFrame:
        tokens = names.select(*on, "__name", F.size(words()).alias("__n"), F.explode(words()).alias("__t")).join(counts, [*on, "__t"])
        ranked = tokens.groupBy(*on, "__name", "__n").agg(F.array_sort(F.collect_list(F.struct("__f", "__t"))).alias("__ts"))
        keep = F.col("__n") - F.ceil(F.col("__n") * F.lit(rules.SIMILARITY_MIN) - F.lit(1e-9)) + 1
        # A short name's tokens look for long names only; a long name's look for either.
        long = F.col("__n") > FEW
        met = F.when(long, F.array(F.lit(f"t{own}:"), F.lit("tt:"))).otherwise(F.array(F.lit(f"t{other}:")))
        rare = ranked.withColumn("__met", F.explode(met)).select(
            *on, "__name", "__n", "__met", F.posexplode(F.slice("__ts", F.lit(1), keep.cast("int"))).alias("__i", "t")).select(
            *on, "__name", F.concat("__met", "t.__t").alias("__k"), "__n", "__i")
        few = ranked.filter(~long).crossJoin(F.broadcast(sizes)).select(*on, "__name", F.explode(_together(
            F.col("__n"), F.transform("__ts", lambda t: t["__t"]), F.col("__sizes"))).alias("__k"))
        whole = names.select(*on, "__name", F.concat(F.lit(f"{own}:"), F.col("__name")).alias("__k"))
        fits = F.filter("__lens", lambda n: n <= F.length("__name"))
        begun = names.filter(F.length("__name") >= least).withColumn("__lead", lead).join(lengths, [*on, "__lead"]).select(
            *on, "__name", F.explode(F.transform(fits, lambda n: F.concat(F.lit(f"{other}:"), F.substring(F.col("__name"), F.lit(1), n)))).alias("__k"))
        short = names.filter(F.length("__name") < least).select(*on, "__name", F.concat(F.lit(f"{other}:"), F.col("__name")).alias("__k"))
        return rare.unionByName(few.unionByName(whole).unionByName(begun).unionByName(short), allowMissingColumns=True)

    other = keys(b, "b", "a").withColumnsRenamed({"__name": "__name_2", "__n": "__m", "__i": "__j"})
    share = F.ceil((F.col("__n") + F.col("__m")) * F.lit(rules.SIMILARITY_MIN / (1 + rules.SIMILARITY_MIN)) - F.lit(1e-6))
    can = F.least(F.col("__n") - F.col("__i"), F.col("__m") - F.col("__j")) >= share
    pairs = keys(a, "a", "b").join(other, [*on, "__k"]).filter(F.col("__n").isNull() | can).select(*on, "__name", "__name_2").distinct()
    return pairs.filter(same_name(F.col("__name"), F.col("__name_2"))).select(*on, F.col("__name").alias(name), F.col("__name_2").alias(f"{name}_2"))


def resolve(before: DataFrame, after: DataFrame, page: list[str]) -> DataFrame:
    """Finds every earlier control again: by id while its name is the same, else by fingerprint.

    Both sides: page, element_id, name, tag, role, context. Adds ``outcome`` (same_id, semantic, ambiguous_target or
    unknown_target) and ``resolved_id``. Fingerprints are counted before they meet, so many alike controls stay one row.
    """
    finger = ["name", "tag", "role", "context"]
    same_id = after.select(*page, "element_id", F.col("name").alias("__live"))
    tried = before.withColumn("context", F.coalesce("context", F.lit(""))).join(same_id, [*page, "element_id"], "left")
    tried = tried.withColumn("__by_id", F.coalesce(same_name(F.col("__live"), F.col("name")), F.lit(False)))
    lost = tried.filter(~F.col("__by_id") & (F.col("name") != "")).select(*page, *finger).distinct()
    seen = after.withColumn("context", F.coalesce("context", F.lit(""))).groupBy(*page, *finger).agg(
        F.count("*").alias("__c"), F.min("element_id").alias("__id")).select(
        *page, *[F.col(c).alias(f"{c}_2") for c in finger], "__c", "__id")
    pairs = lost.join(similar_names(lost, after, page), [*page, "name"]).join(seen, [*page, "name_2"])
    fits = ((F.col("role") == F.col("role_2")) | (F.col("tag") == F.col("tag_2"))) & (
        (F.col("context") == "") | (F.col("context_2") == "") | (F.col("context") == F.col("context_2")))
    matches = pairs.filter(fits).groupBy(*page, *finger).agg(F.sum("__c").alias("__m"), F.min("__id").alias("__to"))
    done = tried.join(matches, [*page, *finger], "left")
    n = F.coalesce("__m", F.lit(0))
    outcome = F.when(F.col("__by_id"), "same_id").when(n == 1, "semantic").when(n > 1, "ambiguous_target").otherwise("unknown_target")
    target = F.when(F.col("__by_id"), F.col("element_id")).when(n == 1, F.col("__to"))
    return done.withColumn("outcome", outcome).withColumn("resolved_id", target).drop("__live", "__by_id", "__m", "__to")


def site_label(url: Column) -> Column:
    """Name of a site: host without www, port, top-level part and second-level suffix; empty when there is no host."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    parts = F.filter(F.split(F.regexp_replace(F.split_part(host, F.lit(":"), F.lit(1)), r"^www\.", ""), r"\."), lambda p: p != "")

    def pick(labels: Column) -> Column:
        n = F.size(labels)
        second = F.get(labels, n - 2).isin(rules.SECOND_LEVEL_SUFFIXES) & (n >= 3) & (F.length(F.get(labels, n - 1)) <= 3)
        return F.when(n == 0, "").when(n == 1, F.get(labels, 0)).when(second, F.get(labels, n - 3)).otherwise(F.get(labels, n - 2))

    return let(parts, pick)
