"""Personal data: strict formats, and high-recall candidates selected by gradient-boosted trees.

Base spans (email, ip, card, phone) are found by format and check. Wide generators then propose further spans,
overlapping as they may: written-out addresses, defanged or long IP addresses, oddly grouped cards, phone numbers
without a country code. Boosted trees score each candidate from its format and its context (the characters between the
candidate before it and itself), and a threshold per kind selects what is added; of overlapping candidates the best stays.

The trees are fitted once per process on ``examples`` generated labelled rows (the bound, 3000; nothing is read from the
corpus). A row fills a form of value into a context. Thresholds are calibrated for precision on margins from trees that saw
neither the form nor the context (cross-fitting by template), then the trees are fitted on all rows and compiled to built-in
expressions: scanning has no user function and no shuffle. Time follows a text's length.
Null text: empty. Equal rows get equal results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import text_or_empty
from cohortry.llm.spans import blocked, count_of, joined, let, meets, of_kind, spans

KINDS = ("email", "ip", "card", "phone")
#: The strict formats. Look-behinds only save time: a match can begin inside a run of its first characters only right after another match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: The generators, by kind.
GENERATORS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\)|\x20at\x20|\[@\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\)|\[\.\]|\x20dot\x20)\x20?[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\]|\.\x20)){3}[0-9]{1,3}(?![0-9])|(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}::?){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
    r"|(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
    r"(?<![0-9.])[0-9](?:[\x20.\-]{0,2}[0-9]){12,18}(?![0-9])",
    r"(?<![0-9A-Za-z+.\-])(?:00)?\(?[0-9]{2,4}\)?(?:[\x20.\-/]{1,2}\(?[0-9]{2,5}\)?){2,5}(?![0-9A-Za-z]|[.\-][0-9])",
)
CUES = (r"mail|contact|write|reach|address", r"\bip\b|host|server|addr|login from|client", r"card|visa|credit|debit|payment|paid|amex|mastercard", r"tel|phone|call|mobile|cell|fax|whatsapp|dial")
AGAINST = r"order|invoice|version|isbn|\bref\b|\bno\b|number of|\bid\b|date|page|sku|serial|tracking|chapter|score|total|at \d|\bon\b"
FEATURES = ("kind0", "kind1", "kind2", "kind3", "chars", "digits", "letters", "groups", "spaces", "dashes", "dots", "brackets", "slashes", "colons", "at_sign", "written_at", "written_dot", "plus", "luhn", "first_zero", "distinct", "octets", "date", "cue", "against", "longest_group", "shortest_group", "last_group", "year", "closed", "sentence", "last_label", "number_first", "unclosed_dots")


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digit string passes the Luhn check; false for an empty one."""

    def step(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        doubled = (F.length(digits) - i) % 2 == 1
        return acc + F.when(doubled, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.when(F.length(digits) > 0, F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    """Sorted (s, k, e) of the strict formats that pass their checks."""
    ip = F.filter(spans(text, IP), lambda x: ~F.exists(F.split(x["t"], r"\."), lambda p: p.cast("double") > 255))
    card = F.filter(spans(text, CARD), lambda x: let(_digits(x["t"]), lambda d: (F.length(d) <= 19) & luhn(d)))
    phone = F.filter(spans(text, PHONE), lambda x: F.length(_digits(x["t"])).between(10, 15))
    return F.sort_array(F.concat(*[of_kind(v, k) for k, v in enumerate((spans(text, EMAIL), ip, card, phone))]))


def candidates(text: Column) -> Column:
    """(s, e, t, b, k) of all generators; b: what stands before it."""
    def named(found: Column, kind: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), x["b"].alias("b"), F.lit(kind).alias("k")))

    return F.concat(*[named(spans(text, g, CONTEXT), k) for k, g in enumerate(GENERATORS)])


def features(x: Column) -> list[Column]:
    """Format and context of a candidate, in the order of :data:`FEATURES`, as doubles."""
    t, k = x["t"], x["k"]
    digits = _digits(t)
    before = F.lower(x["b"])
    number = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    cue = reduce(lambda acc, i: F.when(k == i, before.rlike(CUES[i])).otherwise(acc), range(len(CUES)), F.lit(False))
    sizes = F.transform(F.regexp_extract_all(t, F.lit("[0-9A-Za-z]+"), 0), F.length)
    values = [
        *[k == i for i in range(4)], F.length(t), F.length(digits), number("[A-Za-z]"), F.regexp_count(t, F.lit("[0-9A-Za-z]+")), number(r"\x20"), number("-"), number(r"\."), number(r"[\[\]()]"), number("/"), number(":"),
        t.contains("@"), t.rlike(r"[\[(]at[\])]|\x20at\x20"), t.rlike(r"[\[(]dot[\])]|\x20dot\x20|\[\.\]"), t.contains("+"), F.length(digits).between(13, 19) & luhn(digits), digits.startswith("0"), F.size(F.array_distinct(F.split(digits, ""))),
        t.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})[^0-9A-Za-z]*(?:dot)?[^0-9A-Za-z]*){4}$"), t.rlike(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}"), cue, before.rlike(AGAINST),
        F.array_max(sizes), F.array_min(sizes), F.element_at(sizes, -1), t.rlike("(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"), t.rlike(r"^\(.*\)$"), t.rlike(r"[.!?]\x20?[A-Z]"), t.rlike(r"[.\])\x20][a-z]{2,4}$"), t.rlike(r"^[0-9]+\x20"), number(r"\.\x20"),
    ]
    return [v.cast("double") for v in values]


#: Examples, by kind: forms of personal data, forms of other things, contexts that name the kind, contexts that name something else.
#: In a form, # is a random digit, * a random letter, ^ a random hex letter, and ~ the digit that completes a Luhn check. {} in a context is the value.
_FORMS = (
    ("***.*****## [at] *****# [dot] org", "*.*****(at)****#.example.com", "***## at *****# dot com", "****.## [at] ****# [dot] net", "****##[@]*****#.org", "*****_** at ****.de", "****.**** (at) *****.co.uk", "*****## @ ****** . com", "***@*****[dot]com", "****-***(at)*****(dot)edu", "**** [at] ***.*****.fr", "******# at **** dot co dot uk"),
    ("1##[.]##[.]1##[.]##", "10[.]##[.]#[.]1##", "2001:db8:##^3:8^#:##:8^2^:37#:##3", "fe80:##^1:^##:^#^2^:##^0:1^2^:3^##:^^##", "1##(.)##(.)##(.)##", "2001:db8::#", "2001:db8:##::#^", "fe80::#", "fe80::##^#", "192[dot]168[dot]#[dot]1##", "172[.]1#[.]##[.]#", "::1", "2^0#:##^8:#::#", "fd##:^##^:1::##"),
    ("4##############~", "4###.####.####.###~", "5###  ####  ####  ###~", "4###########~", "3### ###### ####~", "5### - #### - #### - ###~", "4### .#### .#### .###~", "6###.######.#####~", "4###--####--####--###~"),
    ("(###) 555-####", "0## #### ####", "07#-###-####", "0044 20 79## ####", "(0##) ####-####", "555-###-####", "020 7### ####", "(###) ###-####", "0#.##.##.##.##", "00 49 30 #### ##", "0##/####-###", "###.###.####", "0## ## ## ## ##", "001 ### ### ####"),
)
_OTHERS = (
    ("## at noon.Then", "# at once.Some", "1## at sea.They", "back at home.And", "met at ****.They", "****s at work.Some", "# at ##.##", "## at #.##", "1# at 1##.##", "closely at this. It", "good at chess. She", "look at them . He", "live at two dot matrix", "work at one dot two", "aim at a dot there", "*** at ****. ***", "**** at ***.** **", "*** at once. The"),
    ("#. ##. ##. ##", "#. #. #. #", "1#. 2#. 3#. 4#", "0#:1#:2#:3#", "0#:##:##:##", "12:##:##:##", "##:##:##:##", "#:#:#:#", "#:##:#:##", "Add::Bee", "Abc::Deb", "Bed::Fad", "a::b", "ad::", "^^^::^^^", "Cafe::Dad#", "Bead::Add#", "Face::Cab#"),
    ("##############9#", "0000#############", "20##############", "9#################", "8##################", "7###-####-####-####", "#############", "1#############", "2############", "################", "20######-########", "19######-#######", "## ## ## ## ## ## ## ##", "##.##.##.##.##.##.##", "1# 2# ## ## ## ## ##", "31415926535897####", "# ## ### #### #####", "1 2 3 4 5 6 7 8 9 10 1# 12"),
    ("12-05-20##", "0#-1#-20##", "2#-1#-19##", "20##-03-1#", "20##/##/##", "19##.##.##", "1## 1## 2## 2##", "1## 2## 3##", "10 20 30 40", "21-1# 19-2# 22-20", "##-## ##-##", "1#-# 2#-## 1#-##", "978-#-##-######-#", "979-##-####-###-#", "978-#-####-####-#", "0#/1#/20## 1#", "1#/0#/19##", "##.##.20##", "## ## ## ##", "### ## ###", "1##-2## 3##-4##", "#### #### ####", "20##-20## 20##", "19##-19##, 20##"),
)
_NAMING = (
    ("please write to {} about it", "contact me at {} today", "my mail is {} if needed", "reach us via {} now", "e-mail: {}", "send an email to {}.", "the address is {} for mail", "you can mail {}, thanks", "contact: {}"),
    ("login from {} failed", "the server {} answered", "client {} timed out", "the host {} is up", "ip {} was blocked", "connect to server {}.", "remote addr {}, port 22", "seen on host {} twice", "clients such as {} wait"),
    ("charged to card {} last week", "my visa {} expires soon", "credit card {} was used", "payment by {} done", "debit card {} please", "paid with mastercard {}.", "amex {}, exp 12/27", "the card: {}", "visa {}"),
    ("call {} tomorrow", "phone: {} or mail", "mobile {} any time", "tel. {} please", "fax {} works", "dial {} for help", "my cell is {}.", "whatsapp {}, anytime", "please call {}. We wait", "phone {}"),
)
_AGAINST = (
    ("we met {} and left", "they stare {} all day", "it sells for {} each", "he was {} too", "score {} today", "on page {} we read", "the {} was fun", "they {} and so on"),
    ("the method {} returns", "ratio {} holds", "see chapter {} for more", "split times {} were", "the list has {} items", "version {} is out", "page {} of it", "the type {} is old"),
    ("the order {} was sent", "tracking {} shows", "serial {} on the back", "invoice {} is due", "id {} in the table", "values {} follow", "isbn {} is out", "number of rows {} so far", "the total {} grew"),
    ("on {} we met", "dated {} in town", "isbn {} is out", "see pages {}.", "the score {} again", "rows {} in all", "order {} was sent", "chapter {} ends", "date: {}", "invoice {} is due", "version {} came"),
)
_PLAIN = ("{}", "and then {} came", "it says {} here", "{} is what they wrote", "so {} it was", "with {} and more", "as in {}, for instance", "we saw {}.", "found {}; nothing else", "({}) was given", "see ({}) there", "it ({}) is so", "then {} - and on")
CONTEXT = 40
FOLDS = 3


def labelled_examples(spark: SparkSession, examples: int, seed: int) -> DataFrame:
    """``examples`` generated rows: id, text, label (1: personal data), kind, and the folds of the form and of the context."""
    array = lambda values: F.array(*[F.lit(v) for v in values])
    draw = lambda i, n: F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(i)), n).cast("int")
    rows = spark.range(0, examples, 1, 4).select("id", draw(1, F.lit(4)).alias("kind"), draw(2, F.lit(2)).alias("label"), draw(3, F.lit(3)).alias("named"))
    form = F.when(F.col("label") == 1, F.get(F.array(*map(array, _FORMS)), F.col("kind"))).otherwise(F.get(F.array(*map(array, _OTHERS)), F.col("kind")))
    named = F.when(F.col("label") == 1, F.get(F.array(*map(array, _NAMING)), F.col("kind"))).otherwise(F.get(F.array(*map(array, _AGAINST)), F.col("kind")))
    rows = rows.select("*", form.alias("forms"), F.when(F.col("named") > 0, named).otherwise(array(_PLAIN)).alias("contexts"))
    rows = rows.select("id", "kind", "label", "forms", "contexts", draw(4, F.size("forms")).alias("form"), draw(5, F.size("contexts")).alias("context"))
    digits = F.concat(*[F.lpad(F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(10 + i)), F.lit(10**9)).cast("string"), 9, "0") for i in range(4)])
    rows = rows.select("*", F.get("forms", F.col("form")).alias("value"), digits.alias("draw"))
    letter = lambda of, i: F.substr(F.lit(of), F.substr("draw", i % 36 + 1, F.lit(1)).cast("int") + 1, F.lit(1))
    filled = F.array_join(F.transform(F.split("value", ""), lambda c, i: F.when(c == "#", F.substr("draw", i % 36 + 1, F.lit(1))).when(c == "*", letter("aeirstlnmo", i)).when(c == "^", letter("abcdefabcd", i)).otherwise(c)), "")
    rows = rows.withColumn("filled", filled)
    # the digit that completes the check is the one that passes
    done = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.replace("filled", F.lit("~"), d.cast("string"))), lambda v: ~F.col("filled").contains("~") | luhn(_digits(v))), 0)
    return rows.select("id", "kind", "label", (F.col("form") % FOLDS).alias("form_fold"), (F.col("context") % FOLDS).alias("context_fold"), F.replace(F.get("contexts", F.col("context")), F.lit("{}"), done).alias("text"))


class Selector:
    """Boosted trees as data: per tree its weight and nested (feature, threshold, left, right) or leaf values; per kind the least margin.

    ``scored``: the margins that the least ones come from, as (kind, label, margin, fold).
    """

    def __init__(self, trees: list[tuple[float, object]], least: list[float], scored: list[tuple] = ()):
        self.trees, self.least, self.scored = trees, least, scored

    def unseen(self, precision: float) -> dict[str, tuple[float, float]]:
        """Per kind, precision and recall on forms and contexts that neither trees nor thresholds have seen: each fold by thresholds from the others."""
        out = {}
        for k, name in enumerate(KINDS):
            own = [x for x in self.scored if x[0] == k]
            least = [least_margins([x for x in own if x[3] != fold], precision)[k] for fold in range(FOLDS)]
            added = [label for _, label, m, fold in own if m >= least[fold]]
            out[name] = (sum(added) / max(1, len(added)), sum(added) / max(1, sum(x[1] for x in own)))
        return out

    def margin(self, values: list[Column]) -> Column:
        def node(n) -> Column:
            if isinstance(n, float):
                return F.lit(n)
            feature, threshold, left, right = n
            return F.when(values[feature] <= threshold, node(left)).otherwise(node(right))

        return reduce(lambda a, b: a + b, [w * node(t) for w, t in self.trees])


_fitted: dict[tuple, Selector] = {}


def scored_by(trees: Selector) -> Column:
    return trees.margin([F.get("values", i) for i in range(len(FEATURES))])


def least_margins(scored: list[tuple], precision: float) -> list[float]:
    """Per kind the least margin from which on ``precision`` is reached, over (kind, label, margin, fold)."""
    least = [float("inf")] * len(KINDS)
    for k in range(len(KINDS)):
        own, good = sorted(((m, label) for kind, label, m, _ in scored if kind == k), reverse=True), 0.0
        for i, (m, label) in enumerate(own):
            good += label
            if good >= precision * (i + 1) and (i + 1 == len(own) or own[i + 1][0] < m):
                least[k] = m
    return least


def fit(spark: SparkSession, examples: int = 3_000, rounds: int = 8, depth: int = 4, precision: float = 0.99, seed: int = 5) -> Selector:
    """Trees fitted on all examples, with thresholds from trees that saw neither form nor context of what they score."""
    key = (examples, rounds, depth, precision, seed)
    if key in _fitted:
        return _fitted[key]
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = labelled_examples(spark, examples, seed)
    rows = free_candidates(rows, ["id", "kind", "label", "form_fold", "context_fold"]).withColumn("x", F.explode("_wide"))
    right = ((F.col("label") == 1) & (F.col("x.k") == F.col("kind"))).cast("double")  # a candidate of another kind is not what the row holds
    rows = rows.select("form_fold", "context_fold", right.alias("label"), F.col("x.k").alias("k"), F.array(*features(F.col("x"))).alias("values"))
    rows = rows.withColumn("features", array_to_vector("values")).cache()

    def walk(n) -> object:
        if n.getClass().getSimpleName() == "LeafNode":
            return float(n.prediction())
        return n.split().featureIndex(), float(n.split().threshold()), walk(n.leftChild()), walk(n.rightChild())

    def trees(part: DataFrame) -> Selector:
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, cacheNodeIds=False).fit(part)
        return Selector([(float(w), walk(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)], [])

    scored = []  # at most one (kind, label, margin, fold) for each candidate in the examples
    for fold in range(FOLDS):
        form, context = F.col("form_fold") == fold, F.col("context_fold") == fold
        apart = trees(rows.filter(~form & ~context))
        scored += [(*r, fold) for r in rows.filter(form & context).select("k", "label", scored_by(apart)).collect()]
    found = Selector(trees(rows).trees, least_margins(scored, precision), scored)
    rows.unpersist()
    _fitted[key] = found
    return found


def best_of(chosen: Column) -> Column:
    """Of ``chosen`` ((s, k, e, m), sorted by start) those that a choice by falling m keeps, each free of those kept before.

    A round keeps what is better than all it overlaps, and takes it away with what it overlaps; rounds go on while any are left.
    """
    better = lambda y, x: (y["m"] > x["m"]) | ((y["m"] == x["m"]) & ((y["s"] < x["s"]) | ((y["s"] == x["s"]) & ((y["k"] < x["k"]) | ((y["k"] == x["k"]) & (y["e"] > x["e"]))))))

    def round_of(acc: Column, _: Column) -> Column:
        top = let(blocked(acc["rest"]), lambda b: F.filter(acc["rest"], lambda x: ~meets(x, b, lambda y: better(y, x))))
        taken = let(top, lambda t: F.struct(F.concat(acc["kept"], t).alias("kept"), let(blocked(t), lambda b: F.filter(acc["rest"], lambda x: ~meets(x, b))).alias("rest")))
        return F.when(F.size(acc["rest"]) > 0, taken).otherwise(acc)

    start = F.struct(F.filter(chosen, lambda x: F.lit(False)).alias("kept"), chosen.alias("rest"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(chosen), F.lit(1))), start, round_of, lambda acc: acc["kept"])


def free_candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs``, ``base`` (sorted (s, k, e)) and ``_wide``: candidates that meet no base span."""
    read = docs.select(*[docs[c] for c in keep], text_or_empty(docs).alias("_text"))
    read = read.select(*keep, base_spans(F.col("_text")).alias("base"), candidates(F.col("_text")).alias("_wide"))
    blocks = read.select(*keep, "base", "_wide", F.when(F.size("_wide") > 0, blocked(F.col("base"))).alias("_blocks"))
    return blocks.select(*keep, "base", F.when(F.size("_wide") > 0, F.filter("_wide", lambda x: ~meets(x, F.col("_blocks")))).otherwise(F.array().cast("array<struct<s:int,e:int,t:string,b:string,k:int>>")).alias("_wide"))


def scan(docs: DataFrame, selector: Selector) -> DataFrame:
    """doc_id, ``base`` and ``all``: sorted (s, k, e). Candidates that meet a base span are not added."""
    free = free_candidates(docs, ["doc_id"])
    least = F.array(*[F.lit(float(v)) for v in selector.least])

    def score(x: Column) -> Column:
        return let(F.array(*features(x)), lambda v: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), selector.margin([F.get(v, i) for i in range(len(FEATURES))]).alias("m")))

    scored = free.select("doc_id", "base", F.sort_array(F.filter(F.transform("_wide", score), lambda x: x["m"] >= F.get(least, x["k"]))).alias("_chosen"))
    best = F.transform(best_of(F.col("_chosen")), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return scored.select("doc_id", "base", F.when(F.size("_chosen") > 0, F.sort_array(F.concat("base", best))).otherwise(F.col("base")).alias("all"))


def report(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    found = scan(docs, selector or fit(docs.sparkSession))
    return found.select("doc_id", *[count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("all"), KINDS).alias("spans"))
