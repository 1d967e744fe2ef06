r"""Personal data in whole texts: base patterns, and a bootstrapped extraction that learns from where these stand.

Base. A pattern's matches come from regexp_extract_all and the gaps between them from split on the same pattern; running
sums of their lengths give each match's place in code points. The patterns are rewritten so that the JVM's engine runs in linear time
and without recursion over long runs: separators inside a run are first turned into one private letter each, which keeps places.

Bootstrapping. An instance is a run of characters without white space that holds a digit or @, with the groups of up to five digits (15 after a plus sign) that follow it after single spaces
(a number written in parts is one instance), at least four digits or an @ in it; quotes, brackets and punctuation around it don't count. Its lexical patterns are
the two words before it, the word before it with the instance's shape, and the words before and after it; words are taken whole, and an instance in
their place is one word, whatever it is, and a pattern of nothing else is none. Seeds are instances that a base span touches, and, for a kind of its own that is not in the base,
long hexadecimal secrets. In turns, a pattern's score is the mean of its instances' scores, damped by how few distinct seeds it has, and an instance's score
is the chance that one of its patterns is right. Patterns of at least `least` and SEEDS distinct seeds are trusted, and an
instance under them that no base span touches becomes a span of the pattern's kind. A seed alone is none: a secret needs a trusted pattern too. Texts that
are equal count once. Both sides are aggregated before they are joined, so that a frequent instance or pattern is one row; only instances, never texts, are shuffled.

Null text is empty text: no spans. Null ids and repeated rows are kept, each row with its own spans. An empty table gives no rows; other
columns are not read. All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, recounted

#: The kinds in their order. E000 stands for a space or hyphen between digits, E001 for a dot between letters, digits or hyphens.
KINDS = ("email", "ip", "card", "phone")
#: The kind that only the method finds, after those of the base.
SECRET = "secret"
ALL_KINDS = (*KINDS, SECRET)
DIGIT_RUN, DOT_RUN = "\ue000", "\ue001"
LOCAL, DOMAIN = f"A-Za-z0-9._%+{DOT_RUN}-", "A-Za-z0-9-"
PATTERNS = {
    "email": f"(?:(?<![{LOCAL}])|\\\\G)[{LOCAL}]++@[{DOMAIN}]++{DOT_RUN}[A-Za-z0-9{DOT_RUN}-]++",
    "ip": "(?<![0-9])[0-9]++[.][0-9]++[.][0-9]++[.][0-9]++",
    "card": f"[0-9][0-9{DIGIT_RUN}]++",
    "phone": "[+][0-9][ ().0-9-]+[0-9]",
}
#: What a text needs for a kind's pattern to be tried at all.
NEEDS = {"email": "instr(t, '@') > 0", "ip": "t rlike '[0-9][.][0-9]'", "card": "t rlike '[0-9]'", "phone": "t rlike '[+][0-9]'"}
READ = {
    "email": f"regexp_replace(t, '(?<=[{DOMAIN}])[.](?=[{DOMAIN}])', '{DOT_RUN}')",
    "ip": "t",
    "card": f"regexp_replace(t, '(?<=[0-9])[ -](?=[0-9])', '{DIGIT_RUN}')",
    "phone": "t",
}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
TWICE = f"2 * cast(substring({DIGITS}, length({DIGITS}) - i + 1, 1) as int)"
LUHN = f"aggregate(sequence(1, length({DIGITS})), 0, (a, i) -> a + case when i % 2 = 1 then cast({TWICE} div 2 as int) when {TWICE} > 9 then {TWICE} - 9 else {TWICE} end) % 10 = 0"
HOLDS = {
    "email": "true",
    "ip": f"s.value rlike '^{PART}[.]{PART}[.]{PART}[.]{PART}$'",
    "card": f"case when length({DIGITS}) between 14 and 19 then {LUHN} else false end",
    "phone": f"length({DIGITS}) between 10 and 15",
}
PLACED = "array<struct<start:int,stop:int,value:string>>"
SPANS = "array<struct<start:int,rank:int,stop:int>>"
#: Matches that are placed together.
BLOCK = 256
#: Rounds of the graph, distinct seeds that a trusted pattern has at least.
ROUNDS, SEEDS = 3, 5
GROUP = "[ ][(+]?+[0-9]{{1,{most}}}+(?:[).-]++[0-9]{{1,{most}}}+)*+[)]?+(?![0-9A-Za-z@_])"
INSTANCE = "|".join(f"(?<![^\\\\s])[^\\\\s0-9@{plus}]*+{first}[^\\\\s]*+(?:{GROUP.format(most=most)})*+" for plus, first, most in (("+", "[+][0-9]", 15), ("", "[0-9@]", 5)))
#: Patterns without a word are none.
BARE = "^(2:[#^] [#^]|[sr]:[#^] .*)$"
LEAD, TRAIL = "^[^0-9A-Za-z+@]*+", "[^0-9A-Za-z]*$"
HEX = "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}$"


def placed(found: str, gaps: str, keep: str = "true") -> str:
    """SQL: (start, stop, value) of each match, from the matches and the lengths of the gaps around them; by blocks, as appending copies."""
    last = "if(size(a) > 0, element_at(a, -1).stop, if(size(o) > 0, element_at(o, -1).stop, 0))"
    start = f"{last} + element_at({gaps}, i)"
    row = f"named_struct('start', {start}, 'stop', {start} + length(element_at({found}, i)), 'value', element_at({found}, i))"
    none = f"cast(array() as {PLACED})"
    block = f"aggregate(sequence({BLOCK} * k + 1, least(size({found}), {BLOCK} * k + {BLOCK})), {none}, (a, i) -> cast(array_append(a, {row}) as {PLACED}))"
    every = f"aggregate(sequence(0, cast((size({found}) - 1) div {BLOCK} as int)), {none}, (o, k) -> cast(concat(o, {block}) as {PLACED}))"
    return f"case when size({found}) = 0 then {none} else filter({every}, s -> {keep}) end"


def matched(pattern: str, read: str, needs: str) -> tuple[str, str]:
    """SQL of the matches and of the gaps' lengths; empty where the text doesn't have what the pattern needs."""
    found = f"case when {needs} then regexp_extract_all({read}, '{pattern}', 0) else cast(array() as array<string>) end"
    return found, f"case when {needs} then transform(split({read}, '{pattern}', -1), x -> length(x)) else cast(array() as array<int>) end"


def base_spans(docs: DataFrame) -> DataFrame:
    """docs and spans: each row's base spans, by start, then kind."""
    t = F.translate(F.coalesce("text", F.lit("")), DIGIT_RUN + DOT_RUN, "??")
    out = docs.withColumn("t", t)
    for k in KINDS:
        found, gaps = matched(PATTERNS[k], READ[k], NEEDS[k])
        out = out.withColumns({f"m_{k}": F.expr(found), f"g_{k}": F.expr(gaps)})
    out = out.withColumns({f"s_{k}": F.expr(placed(f"m_{k}", f"g_{k}", HOLDS[k])) for k in KINDS})
    ranked = ", ".join(f"transform(s_{k}, s -> named_struct('start', s.start, 'rank', {n}, 'stop', s.stop))" for n, k in enumerate(KINDS))
    return out.withColumn("spans", F.expr(f"array_sort(concat({ranked}))"))


def instances(rows: DataFrame) -> DataFrame:
    """rows (with t and spans) and words: place, value and patterns of each instance, and the rank of the base kind that it touches, or of secrets."""
    needs = "t rlike '[0-9@]'"
    found, gaps = matched(INSTANCE, "t", needs)
    between = f"case when {needs} then transform(split(t, '{INSTANCE}', -1), x -> trim(regexp_replace(lower(x), '\\\\s+', ' '))) else cast(array() as array<string>) end"
    out = rows.withColumns({"m": F.expr(found), "g": F.expr(gaps), "b": F.expr(between)}).withColumn("w", F.expr(placed("m", "g")))
    # The words around: where a gap has too few, the instance next to it stands for one.
    out = out.withColumn("l", F.expr("transform(b, (x, i) -> concat(if(i = 0, '^ ^ ', '# # '), x))")).withColumn("r", F.expr("transform(b, (x, i) -> if(x = '', if(i = size(b) - 1, '$', '#'), substring_index(x, ' ', 1)))"))
    # Without what stands around it: v and how much was cut in front; both from the match itself.
    lead = f"length(regexp_extract(w1.value, '{LEAD}', 0))"
    bare = f"regexp_replace(regexp_replace(w1.value, '{LEAD}', ''), '{TRAIL}', '')"
    out = out.withColumn("w", F.expr(f"transform(w, (w1, i) -> named_struct('start', w1.start + {lead}, 'value', lower({bare}), 'size', length({bare}), 'left', rtrim(l[i]), 'next', r[i + 1]))"))
    touched = "get(filter(spans, s -> s.start < w1.start + w1.size and s.stop > w1.start), 0).rank"
    rank = f"coalesce({touched}, if(w1.value rlike '{HEX}', {len(KINDS)}, null))"
    shape = f"if(w1.value rlike '{HEX}', 'hex', regexp_replace(regexp_replace(w1.value, '[a-z]+', 'a'), '[0-9]', '9'))"
    short = lambda x: f"if(length({x}) > 100, md5({x}), {x})"
    patterns = [("substring_index(w1.left, ' ', -2)", "2"), (f"concat(substring_index(w1.left, ' ', -1), ' ', {shape})", "s"), ("concat(substring_index(w1.left, ' ', -1), ' _ ', w1.next)", "r")]
    listed = ", ".join(f"concat('{mark}:', {short(x)})" for x, mark in patterns)
    word = f"named_struct('start', w1.start, 'stop', w1.start + w1.size, 'value', {short('w1.value')}, 'rank', {rank}, 'base', {touched} is not null, 'patterns', filter(array({listed}), p -> not p rlike '{BARE}'))"
    digits = "length(regexp_replace(w1.value, '[^0-9]', '')) >= 4"
    return out.withColumn("words", F.expr(f"transform(filter(w, w1 -> w1.size > 0 and (instr(w1.value, '@') > 0 or {digits})), w1 -> {word})"))


def trusted(words: DataFrame, least: float) -> DataFrame:
    """(pattern, found, p) of the patterns to trust, with their kinds and scores; words(pattern, value, rank): each instance once for each place."""
    edges = words.groupBy("pattern", "value").agg(F.max("rank").alias("rank"))
    seeds = edges.filter("rank is not null")
    # A pattern with fewer seeds than it takes can't be trusted in any round, as new instances are no seeds.
    enough = seeds.groupBy("pattern").agg(F.count("*").alias("n_seeds"), F.mode("rank").alias("kind")).filter(F.col("n_seeds") >= SEEDS)
    near = edges.join(enough, "pattern").select("pattern", "value", "kind", "n_seeds", F.col("rank").isNotNull().cast("double").alias("seed"))
    scored = near.withColumn("score", F.col("seed"))
    for _ in range(ROUNDS):
        patterns = scored.groupBy("pattern", "kind", "n_seeds").agg(F.avg("score").alias("p")).withColumn("p", F.col("p") * F.col("n_seeds") / (F.col("n_seeds") + 0.5))
        values = near.join(patterns.select("pattern", "p"), "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log1p(-F.least("p", F.lit(0.999)))))).alias("v"))
        scored = near.join(values, "value").select("pattern", "value", "kind", "n_seeds", "seed", F.greatest("seed", "v").alias("score"))
    final = scored.groupBy("pattern", "kind", "n_seeds").agg(F.avg("score").alias("p"))
    damped = F.col("p") * F.col("n_seeds") / (F.col("n_seeds") + 0.5)
    return final.filter(damped >= least).select("pattern", F.col("kind").alias("found"), damped.alias("p"))


def joined(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in ALL_KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat(element_at({names}, s.rank + 1), ':', s.start, ':', s.stop)), ',')"


def masked(text: str, spans: str) -> str:
    """SQL: text with <KIND> in place of each span; overlapping spans are one of the first one's kind. By blocks, as a place is found by counting from the start."""
    last = "element_at(a, -1)"
    grown = f"array_append(slice(a, 1, size(a) - 1), named_struct('start', {last}.start, 'rank', {last}.rank, 'stop', greatest({last}.stop, s.stop)))"
    united = f"aggregate({spans}, cast(array() as {SPANS}), (a, s) -> cast(case when size(a) > 0 and try_element_at(a, -1).stop > s.start then {grown} else array_append(a, s) end as {SPANS}))"
    kinds = "array(" + ", ".join(f"'<{k.upper()}>'" for k in ALL_KINDS) + ")"
    begin = "if(i = 0, b.low, b.own[i - 1].stop)"
    piece = f"concat(substring(b.part, {begin} - b.low + 1, s.start - {begin}), element_at({kinds}, s.rank + 1))"
    low = f"if(k = 0, 0, u[{BLOCK} * k - 1].stop)"
    block = f"named_struct('low', {low}, 'own', slice(u, {BLOCK} * k + 1, {BLOCK}), 'part', substring({text}, {low} + 1, u[least(size(u), {BLOCK} * k + {BLOCK}) - 1].stop - {low}))"
    blocks = f"transform(sequence(0, cast((size(u) - 1) div {BLOCK} as int)), k -> {block})"
    whole = f"concat(array_join(transform({blocks}, b -> array_join(transform(b.own, (s, i) -> {piece}), '')), ''), substring({text}, element_at(u, -1).stop + 1))"
    return f"case when size({spans}) = 0 then {text} else element_at(transform(array({united}), u -> {whole}), 1) end"


KEY = "md5(coalesce(text, ''))"


def redacted(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """docs with <KIND> in place of each span in its texts; null text becomes empty text; n_chars, if there, is counted anew."""
    key, spans = fresh(docs, "text_key"), fresh(docs, "found_spans")
    scratch = Scratch(docs.sparkSession, "pii")
    found = found_spans(docs, least, scratch).filter("size(spans) > 0").groupBy("key").agg(F.first("spans").alias("spans"))
    found = scratch.keep(found.select(F.col("key").alias(key), F.col("spans").alias(spans)))
    scratch.clear(found)
    each = docs.withColumn(key, F.expr(KEY)).join(found, key, "left").withColumn("text", F.coalesce("text", F.lit("")))
    out = each.withColumn(spans, F.coalesce(spans, F.expr(f"cast(array() as {SPANS})")))
    return recounted(out.withColumn("text", F.expr(masked("text", spans))).select(*docs.columns))


def found_spans(docs: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(key, doc_id, base, spans) of docs(doc_id, text): key names the text, base and spans are arrays of (start, rank, stop)."""
    read = docs.select("doc_id", F.expr(KEY).alias("key"), "text")
    rows = scratch.keep(instances(base_spans(read)).select("key", "doc_id", F.expr(f"cast(spans as {SPANS})").alias("base"), "words"))
    # What is found in a text follows from its bytes, so that equal texts are one.
    each = scratch.keep(rows.filter("size(words) > 0").groupBy("key").agg(F.first("words").alias("words")).select("key", F.explode("words").alias("w")).select("key", "w.*"))
    edges = each.select("value", "rank", F.explode("patterns").alias("pattern"))
    good = scratch.keep(trusted(edges, least))
    hits = each.filter("not base").select("key", "start", "stop", F.explode("patterns").alias("pattern")).join(good, "pattern")
    one = hits.groupBy("key", "start", "stop").agg(F.max_by("found", F.struct("p", -F.col("found"))).alias("rank"))
    new = scratch.keep(one.groupBy("key").agg(F.collect_list(F.struct("start", "rank", "stop")).alias("new")))
    every = F.expr(f"array_sort(concat(base, coalesce(cast(new as {SPANS}), cast(array() as {SPANS}))))")
    return rows.join(new, "key", "left").select("key", "doc_id", "base", every.alias("spans"))


def personal_data(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of docs(doc_id, text); n_added: spans that only the method finds."""
    found = found_spans(docs, least, Scratch(docs.sparkSession, "pii"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.rank = {n})) as bigint)").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined("base")), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans"), F.expr("cast(size(spans) - size(base) as bigint)").alias("n_added"))
