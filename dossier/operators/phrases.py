"""Words and phrases by dictionaries that are tables: collapsed words taken
apart, terms replaced wherever they stand, and lines translated by rule.

Dictionaries may be of any size: texts meet them in equi-joins on distinct
words or runs of tokens, never term by term.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import written

#: collapsed words have at least so many letters, their parts at least two
LEAST_COMPOUND, LEAST_PART = 8, 2


def compounds(tokens: DataFrame, words: DataFrame, token: str = "token", word: str = "word") -> DataFrame:
    """(token, parts) for the distinct upper-case tokens that are no word
    themselves and that words make up without rest: of all ways the one with
    the greatest sum of squared lengths, of ties the one whose first part is
    shorter, then the next.

    The stretches of a token that are words come from an equi-join; a fold from
    the token's end then keeps, for each of the next places, the best way on."""
    w = words.select(F.upper(word).alias("w")).where(F.length("w") >= LEAST_PART).distinct()
    w = written(w, "words")
    longest = w.agg(F.max(F.length("w"))).first()[0] or 0
    t = tokens.select(F.upper(token).alias("t")).where(F.length("t") >= LEAST_COMPOUND).distinct().join(w, F.col("t") == F.col("w"), "left_anti")
    n = F.length("t")
    at = t.select("t", F.explode(F.sequence(F.lit(0), n - LEAST_PART)).alias("s"))
    sizes = F.sequence(F.lit(LEAST_PART), F.greatest(F.least(F.lit(longest), n - F.col("s")), F.lit(LEAST_PART)))
    stretches = at.select("t", "s", F.explode(sizes).alias("size")).withColumn("w", F.substring("t", F.col("s") + 1, F.col("size"))).where(F.length("w") == F.col("size"))
    steps = stretches.join(w, "w").groupBy("t", "s").agg(F.array_sort(F.collect_list("size")).alias("sizes")).groupBy("t").agg(F.sort_array(F.collect_list(F.struct("s", "sizes")), asc=False).alias("steps"))
    way = "struct<score: long, short: int, parts: string>"
    none = F.lit(None).cast(way)

    def step(state: Column, x: Column) -> Column:
        # ways from the places after x.s, the next one first
        gap = state["at"] - x["s"] - 1
        later = F.concat(F.when(gap > 0, F.array_repeat(none, F.least(gap, F.lit(longest + 1)))).otherwise(F.array().cast(f"array<{way}>")), state["ways"])
        one = lambda size: F.when(F.get(later, size - 1).isNotNull(), F.struct((size.cast("long") * size + F.get(later, size - 1)["score"]).alias("score"), (-size).alias("short"), F.concat(size.cast("string"), F.lit(" "), F.get(later, size - 1)["parts"]).alias("parts")))
        best = F.array_max(F.array_compact(F.transform(x["sizes"], one))).cast(way)
        return F.struct(x["s"].alias("at"), F.slice(F.concat(F.array(best), later), 1, longest + 1).alias("ways"))

    nothing = F.struct(F.lit(0).cast("long").alias("score"), F.lit(0).alias("short"), F.lit("").alias("parts")).cast(way)
    end = F.struct(n.alias("at"), F.slice(F.array(nothing, none), 1, 1).alias("ways"))  # of a type that may hold nulls
    folded = steps.select("t", F.aggregate("steps", end, step).alias("f")).where("f.at = 0 and f.ways[0] is not null")
    sizes = F.transform(F.filter(F.split(F.col("f.ways")[0]["parts"], " "), lambda x: x != ""), lambda x: x.cast("int"))
    cut = F.aggregate(sizes, F.struct(F.lit(1).alias("from"), F.array().cast("array<string>").alias("parts")), lambda a, k: F.struct((a["from"] + k).alias("from"), F.concat(a["parts"], F.array(F.substring(F.col("t"), a["from"], k))).alias("parts")))
    return folded.select(F.col("t").alias("token"), cut["parts"].alias("parts")).where("size(parts) > 1")


def spaced(df: DataFrame, key: str, column: str, words: DataFrame) -> DataFrame:
    """``column`` with collapsed capitals taken apart and standards set off
    from their numbers; ``key`` is unique."""
    t = F.regexp_replace(text.fold_space(F.coalesce(F.col(column), F.lit(""))), r"(?U)\bWITHE-", "WITH E-")
    t = F.regexp_replace(t, r"(?U)\b(API|ISO|IEC|ASME|ASTM|DIN|EN)([0-9]+)", "$1 $2 ")
    rows = written(df.select(key, t.alias("t")), "texts")
    pieces = rows.select(key, F.posexplode(F.regexp_extract_all("t", F.lit("([A-Z]+|[^A-Z]+)"), 1)).alias("_n", "_piece"))
    found = compounds(pieces.select("_piece"), words, "_piece")
    hit = pieces.join(found, F.col("_piece") == F.col("token")).select(key, "_n", F.array_join("parts", " ").alias("_new"))
    whole = pieces.join(hit, [key, "_n"], "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", F.coalesce("_new", "_piece").alias("p")))).alias("p"))
    out = rows.join(whole, key, "left").select(key, text.fold_space(F.coalesce(F.array_join(F.transform("p", lambda x: x["p"]), ""), F.lit(""))).alias("spaced"))
    return df.join(out, key)


_TOKENS = "([A-Za-z0-9]+|[^A-Za-z0-9])"


def replaced(df: DataFrame, key: str, column: str, terms: DataFrame, to: str = "replaced") -> DataFrame:
    """Adds ``to``: ``column`` (white space folded) with every term (source,
    target) replaced, case aside, where no letter or digit touches it. Longer
    terms go before shorter ones, then by spelling, then from the left; what is
    replaced is not looked at again. ``key`` is unique; of equal sources the
    least target counts; a null text is empty.

    Texts and terms are runs of tokens, a word or another character each; runs
    of the lengths that terms have meet the terms in one equi-join."""
    term = terms.select(text.fold_space(F.col("source")).alias("source"), "target").where("source <> '' and target is not null")
    term = term.groupBy(F.upper("source").alias("gram")).agg(F.min("target").alias("target"))
    term = written(term.withColumn("n", F.size(F.regexp_extract_all("gram", F.lit(_TOKENS), 1))), "terms")
    sizes = sorted(r[0] for r in term.select("n").distinct().collect())  # as many as there are lengths in words
    rows = written(df.select(key, F.regexp_extract_all(text.fold_space(F.coalesce(F.col(column), F.lit(""))), F.lit(_TOKENS), 1).alias("tokens")), "tokens")
    out = rows.select(key, F.array_join("tokens", "").alias("plain"))
    grams = rows.select(key, F.size("tokens").alias("size"), F.transform("tokens", F.upper).alias("u"), F.explode(F.lit(sizes).cast("array<int>")).alias("n")).where("size >= n")
    grams = grams.select(key, "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1), lambda i: F.array_join(F.slice("u", i, F.col("n")), ""))).alias("at", "gram"))
    met = grams.join(term.drop("n"), "gram").groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.length("gram")).alias("long"), "gram", "at", "n", "target"))).alias("met"))
    free = lambda kept, m: ~F.exists(kept, lambda k: (k["at"] < m["at"] + m["n"]) & (m["at"] < k["at"] + k["n"]))
    span = "array<struct<at: int, n: int, target: string>>"
    kept = F.aggregate("met", F.array().cast(span), lambda a, m: F.when(free(a, m), F.concat(a, F.array(F.struct(m["at"], m["n"], m["target"])).cast(span))).otherwise(a))
    chosen = met.select(key, F.array_sort(kept).alias("kept")).join(rows, key)
    built = F.aggregate("kept", F.struct(F.lit(0).alias("at"), F.lit("").alias("t")), lambda a, k: F.struct((k["at"] + k["n"]).alias("at"), F.concat(a["t"], F.array_join(F.slice("tokens", a["at"] + 1, k["at"] - a["at"]), ""), k["target"]).alias("t")))
    rest = F.concat(F.col("b.t"), F.array_join(F.slice("tokens", F.col("b.at") + 1, F.size("tokens")), ""))
    new = chosen.select(key, "tokens", built.alias("b")).select(key, rest.alias("new"))
    told = out.join(new, key, "left").select(key, text.join_cjk(F.coalesce("new", "plain")).alias(to))
    return df.join(told, key, "left")


# fixed values: lines of a form, with what stands for them; {1} and {2} are the groups
FORMS = (
    (r"(?i)^page\s+([0-9]+)\s+of\s+([0-9]+)$", "第 {1} 页，共 {2} 页"),
    (r"(?i)^contract\s+no\.?:?\s*(.*)$", "合同号：{1}"),
    (r"(?i)^doc\.\s*no\.?:?\s*(.*)$", "文件号：{1}"),
    (r"(?i)^rev\.?:?\s*(.*)$", "版本：{1}"),
    (r"(?i)^class:?\s*(.*)$", "等级：{1}"),
)
# fixed values: heads of a line whose rest is a value
HEADS = (("DOCUMENT TYPE", "文件类型"), ("DOCUMENT TITLE", "文件标题"), ("DOCUMENT NUMBER", "文件编号"), ("SITE", "地点"))
#: codes stay as they are
CODE = r"^([A-Z]{1,8}[-/])?[0-9]+[A-Z0-9./()\-:_ ]*$|^[A-Z]{1,8}[-/][0-9]+[A-Z0-9./()\-:_ ]*$"


def _form(c: Column) -> Column:
    """A line of a fixed form in translation, or null; an empty group takes its colon along."""
    out = []
    for pattern, shape in FORMS:
        parts = shape.replace("{2}", "{1}").split("{1}")
        filled = F.concat(*(x for k, p in enumerate(parts) for x in ([F.trim(F.regexp_extract(c, pattern, k))] if k else []) + [F.lit(p)]))
        out.append(F.when(c.rlike(pattern), F.regexp_replace(filled, "：+$", "")))
    return F.coalesce(*out)


def translate_lines(df: DataFrame, key: str, column: str, exact: DataFrame, labels: DataFrame, terms: DataFrame, to: str = "translated") -> DataFrame:
    """Adds ``to``, the translation of each line by rule: the line itself, or
    what follows its bullet or number, in ``exact``; a label of ``labels`` and
    its value; a fixed form; a code as it stands; both sides of a colon; else
    its terms. All dictionaries are (source, target); ``key`` is unique.

    A line gives up to three units, the line, what stands left of its first
    colon and the value; a unit up to three spellings to look for. Each
    dictionary is joined once."""
    known = lambda d, to: d.select(F.upper(text.fold_space(F.col("source"))).alias("source"), F.col("target").alias(to)).groupBy("source").agg(F.min(to).alias(to))
    line = text.fold_space(F.coalesce(F.col(column), F.lit("")))
    head = F.coalesce(*(F.when(F.upper("line").startswith(h + " "), h) for h, _ in HEADS))
    colon = F.instr("line", ":")
    rows = df.select(key, line.alias("line")).withColumn("head", head).withColumn("colon", colon)
    left = F.when(F.col("colon") > 0, text.fold_space(F.substring("line", F.lit(1), F.col("colon") - 1)))
    value = F.when(F.col("head").isNotNull(), F.regexp_replace(F.substring("line", F.length("head") + 1, F.length("line")), "^[ :]+|[ :]+$", "")).when(F.col("colon") > 0, text.fold_space(F.substring("line", F.col("colon") + 1, F.length("line"))))
    rows = written(rows.select("*", left.alias("left"), value.alias("value")), "lines")
    units = rows.select(key, F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("t")) for u in ("line", "left", "value")))).alias("x")).select(key, "x.*").where("t is not null")
    texts = written(units.select("t").distinct(), "units")
    spelled = lambda how, pattern, group: F.struct(F.lit(how).alias("how"), F.upper(F.regexp_extract("t", pattern, group)).alias("source"))
    ways = texts.select("t", F.explode(F.array(spelled(0, "(?s)^.*$", 0), spelled(1, r"^-\s*(.+)$", 1), spelled(2, r"^[0-9]+\s+(.+)$", 1))).alias("w")).select("t", "w.*").where("source <> ''")
    hits = ways.join(known(exact, "target"), "source").where("target <> ''")
    first = hits.groupBy("t").agg(F.min(F.struct("how", "target")).alias("e"))
    byterm = replaced(texts.withColumn("id", F.sha2("t", 256)), "id", "t", terms, "terms")
    said = written(byterm.join(first, "t", "left").select("t", "e", "terms"), "said")
    own = F.when(F.col("e.how") == 0, F.col("e.target"))
    numbered = F.when(F.col("e.how") == 1, F.concat(F.lit("- "), F.col("e.target"))).when(F.col("e.how") == 2, F.concat(F.regexp_extract("t", "^[0-9]+", 0), F.lit(" "), F.col("e.target")))
    # a value that is no entry has its terms replaced; a unit as a line of its own goes through the rules
    told = said.select("t", own.alias("own"), numbered.alias("numbered"), F.coalesce(own, "terms").alias("as_value"), _form(F.col("t")).alias("form"))
    part = lambda u: told.select(F.col("t").alias(u), *(F.col(c).alias(f"{u}_{c}") for c in told.columns if c != "t"))
    all_ = rows.join(part("line"), "line", "left").join(part("left"), "left", "left").join(part("value"), "value", "left")
    all_ = all_.join(known(labels, "label").withColumnRenamed("source", "_label"), F.upper("left") == F.col("_label"), "left")
    v = F.coalesce("value_as_value", F.lit(""))
    labelled = F.when(F.col("label").isNotNull() & (F.col("left") != ""), F.concat("label", F.lit("："), v))
    names = F.create_map(*(F.lit(x) for pair in HEADS for x in pair))
    headed = F.when(F.col("head").isNotNull(), F.when(F.col("value") == "", names[F.col("head")]).otherwise(F.concat(names[F.col("head")], F.lit("："), v)))
    code = lambda c: F.when(c.rlike(CODE), c)
    head_of_left = F.coalesce("left_own", "left_numbered", "left_form", code(F.col("left")), "left_as_value")
    sides = F.when(F.col("colon") > 0, F.trim(F.concat(head_of_left, F.lit("："), v)))
    out = F.coalesce(F.when(F.col("line") == "", ""), "line_own", "line_numbered", labelled, "line_form", headed, code(F.col("line")), sides, "line_as_value")
    return df.join(all_.select(key, out.alias(to)), key, "left")


def latin_words(c: Column) -> Column:
    """Words in Latin letters that no protected token holds."""
    bare = F.regexp_replace(c, "(?U)(?:" + "|".join(KEPT) + ")", "")
    return F.regexp_extract_all(bare, F.lit("([A-Za-z][A-Za-z']*)"), 1)


def is_short_code(c: Column) -> Column:
    """Abbreviations that a translator would only spoil."""
    t = text.fold_space(c)
    return t.rlike(r"^[A-Z]{2,}(?:\s+[A-Z]{2,}){0,2}$") | t.rlike(r"^(?:[A-Z]\.){1,4}[A-Za-z]+$") | t.rlike(r"^(?:[A-Z]\.){2,}[A-Z]?$")


def corrected(source: Column, translated: Column) -> Column:
    """What translators commonly get wrong, put right where the source tells."""
    t, s = text.join_cjk(translated), F.upper(source)
    # fixed values: wrong and right words
    for mark, pairs in (("TRAIN", (("列车", "线"), ("火车", "线"))), ("DOC. NO", (("博士。编号", "文件号"), ("博士编号", "文件号"))), ("SUPPLY", (("供应", "供货"),))):
        new = t
        for wrong, right in pairs:
            new = F.replace(new, F.lit(wrong), F.lit(right))
        t = F.when(s.contains(mark), new).otherwise(t)
    return t


# fixed values: what a translator must leave alone: standards, codes, quantities, units
UNITS = "kg/h|m3/h|m³/h|bar|barg|bara|kW|KW|V|Hz|mm|cm|rpm|cP|MPa|kPa|Pa|%"
KEPT = (
    r"\b(?:API|ISO|IEC|ASME|ASTM|GB|DIN|EN|NACE|ANSI|NPSH)\s*[-A-Z0-9./]*[0-9][-A-Z0-9./]*\b",
    r"\b[A-Z]{1,8}(?:[-/][A-Z0-9]+){1,}\b",
    r"\b[0-9]{2,4}(?:[-/][A-Z0-9]+){1,}\b",
    rf"\b[0-9]+(?:\.[0-9]+)?\s*(?:{UNITS})\b",
    rf"\b(?:{UNITS})\b",
)


#: what a kept token may begin with, one by one: no other place is looked at closely
_KEPT_HEAD = "[" + "".join(sorted({u[0] for u in UNITS.split("|")} | {*string.ascii_uppercase, *string.digits})) + "]"
#: set around what a pattern finds, so that a plain split takes it apart
_EDGE = "\x01"


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``c``, which is computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _parts(c: Column, pattern: str) -> Column:
    """A text in parts, every second one a match of the pattern's one group.

    The pattern runs once; splitting by a pattern would compile it for every
    row, as happens only to texts that hold the edge themselves."""

    def cut(t: Column) -> Column:
        plain = F.split(F.regexp_replace(t, pattern, f"{_EDGE}$1{_EDGE}"), _EDGE, -1)
        pairs = F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), 1), lambda a, b: F.array(a, b))
        return F.when(F.contains(t, F.lit(_EDGE)), F.filter(F.flatten(pairs), lambda x: x.isNotNull())).otherwise(plain)

    return _once(c, cut)


def _odd(i: Column) -> Column:
    return i.bitwiseAND(F.lit(1)) == 1


def masked(c: Column) -> Column:
    """A text's kept tokens under numbers: struct(masked, tokens), in order of
    their places, equal ones each with a number of its own."""
    pattern = rf"(?U)(?={_KEPT_HEAD})\b(" + "|".join(KEPT) + ")"
    n = lambda i: F.shiftright(i, 1).cast("string")
    mark = lambda i: F.concat(F.lit("TKN"), F.when(i < 20_000, F.lpad(n(i), 4, "0")).otherwise(n(i)), F.lit("X"))
    hidden = lambda x, i: F.when(_odd(i), mark(i)).otherwise(x)
    return _once(_parts(c, pattern), lambda p: F.struct(F.array_join(F.transform(p, hidden), "").alias("masked"), F.filter(p, lambda x, i: _odd(i)).alias("tokens")))


def unmasked(masked: Column, tokens: Column) -> Column:
    """The text with its tokens back, also where a translator wrote the marks
    small: one pass, however many they are. What is put back is not looked at
    again, and a mark without a token stays."""
    number = "(?:[0-9]{4}|[1-9][0-9]{4,8})"  # as marks write it
    parts = _parts(masked, f"([Tt](?:(?<=T)KN{number}X|(?<=t)kn{number}x))")
    shown = lambda x: F.coalesce(F.get(tokens, F.substring(x, F.lit(4), F.length(x) - 4).try_cast("int")), x)
    back = F.array_join(F.transform(parts, lambda x, i: F.when(_odd(i), shown(x)).otherwise(x)), "")
    return F.when(F.size(tokens) == 0, masked).otherwise(back)
