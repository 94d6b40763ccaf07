"""Secret scans: strong formats, and weak parts that count only together.

Strong spans (key assignments, access identifiers, long hex) are found by format. Weak parts have types: secrets are
values assigned to a credential's name, tokens that look drawn at random, and shorter hex; what completes them is an access
identifier, a service endpoint (database and storage addresses, named hosts) or a web address. A weak secret is reported only
when a part that complements its type (:data:`COMPLEMENTS`) lies within ``scope`` characters in the same text: parts are
posted to the cells of ``scope`` characters around their start and their end, and an interval join per (document, cell) links
them. A cell holds a bounded number of parts, and a part is in a bounded number of cells, whatever their lengths.
What stands in an address is no secret, but for a value assigned in its query; nor are names of files, paths (what begins with a
slash) and words.

All of it is built-in expressions and joins. Null text: empty. Documents are told apart by doc_id and text, so equal rows get
equal results; a null doc_id is one like any other. Overlapping parts do not complete each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import stage, text_or_empty
from cohortry.llm.spans import blocked, count_of, joined, let, meets, of_kind, spans

#: Of spans. The last is that of random tokens, which only linking adds.
KINDS = ("assign", "access", "hex", "token")
#: The strong formats.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_LONG = r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}$"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
#: Parts that complete secrets.
IDENTIFIER = r"""(?i)(?<![A-Za-z])(?:access[_-]?key[_-]?id|client[_-]?id|user(?:name)?|login|account)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9._@-]{3,}+|(?-i:AKIA[A-Z0-9]{12,}+)"""
SERVICE = r"""(?i)(?<![A-Za-z0-9+.-])(?:jdbc:[a-z]{2,16}|postgres|postgresql|mysql|mongodb(?:\+srv)?|amqps?|rediss?|sftp|ftps?|s3|ldaps?)://[^\s"'<>]{3,}+|(?<![A-Za-z])(?:host(?:name)?|endpoint|server)["']?\x20{0,4}[:=]\x20{0,4}["']?(?:[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|localhost)(?::[0-9]++)?+"""
WEB = r"""(?i)(?<![A-Za-z0-9+.-])https?://[^\s"'<>]{3,}+"""
ADDRESS = r"""(?i)(?<![A-Za-z0-9+.:-])[a-z][a-z0-9+.:-]{1,20}://[^\s"'<>]++"""
#: Parts that can be secrets.
NAMED = r"""(?i)(?<![A-Za-z])(?:pass|pwd|passphrase|auth|private_?key|access_?key|credential)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9+/_.=!@#$%^&*-]{6,}+"""
NAMED_VALUE = r"""[:=]\x20{0,4}["']?(?=[^:]*[0-9])(?=[^:]*[A-Za-z])[A-Za-z0-9+_=!@#$%^&*-][^:]*$"""
TOKEN = r"(?<![A-Za-z0-9+/_=.~-])(?!/)[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-]|\.[A-Za-z])"
SHORT_HEX = r"(?<![0-9A-Za-z])[0-9a-f]{16,31}(?![0-9A-Za-z])"
#: Where the kind of character changes inside a token.
CHANGE = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
#: Kinds of secrets (as in KINDS), and of what completes them; which complement which.
_IDENTIFIER, _SERVICE, _WEB = 8, 9, 10
COMPLEMENTS = {0: (_IDENTIFIER, _SERVICE, _WEB), 3: (_IDENTIFIER, _SERVICE), 2: (_IDENTIFIER,)}


def base_spans(text: Column) -> Column:
    """Sorted (s, k, e) of the strong formats. An assignment counts with 8 characters of value."""
    assign = F.filter(spans(text, ASSIGN), lambda x: x["t"].rlike(ASSIGN_LONG))
    return F.sort_array(F.concat(of_kind(assign, 0), of_kind(spans(text, ACCESS), 1), of_kind(spans(text, HEX), 2)))


def random_looking(t: Column) -> Column:
    """Upper case, lower case and digits, which change at two of five places or more; words and names run on."""
    return t.rlike("[A-Z]") & t.rlike("[a-z]") & t.rlike("[0-9]") & (5 * F.regexp_count(t, F.lit(CHANGE)) >= 2 * (F.length(t) - 1))


def _key(docs: DataFrame) -> list[Column]:
    return [docs["doc_id"].alias("_id"), F.xxhash64(text_or_empty(docs)).alias("_mark")]


def linked(docs: DataFrame, scope: int = 200) -> DataFrame:
    """Weak secrets with an identifier or endpoint in scope: ``_id, _mark`` (of the document) and ``added``, a sorted array of (s, k, e)."""
    text = F.col("_text")
    helps = F.concat(of_kind(spans(text, IDENTIFIER), _IDENTIFIER), of_kind(spans(text, SERVICE), _SERVICE), of_kind(spans(text, WEB), _WEB))
    inside = lambda x, b: meets(x, b, lambda y: (y["s"] < x["s"]) & ~F.substr(text, x["s"], F.lit(1)).isin("?", "&", ";"))
    read = docs.select(*_key(docs), text_or_empty(docs).alias("_text")).select("_id", "_mark", "_text", helps.alias("_helps"))
    # weak secrets are looked for only where something could complete them; parts are few, and both sides of the join read them
    some = read.filter(F.size("_helps") > 0).select(
        "*",
        F.filter(spans(text, NAMED), lambda x: x["t"].rlike(NAMED_VALUE)).alias("_named"),
        F.filter(spans(text, TOKEN), lambda x: random_looking(x["t"])).alias("_tokens"),
        F.filter(spans(text, SHORT_HEX), lambda x: x["t"].rlike("[0-9]") & x["t"].rlike("[a-f]")).alias("_short"),
        spans(text, ADDRESS).alias("_addresses"),
    )
    some = some.select("*", blocked(F.col("_addresses")).alias("_blocks"))
    weak = [of_kind(F.filter("_named", lambda x: ~inside(x, F.col("_blocks"))), 0), *[of_kind(F.filter(c, lambda x: ~meets(x, F.col("_blocks"))), k) for c, k in (("_tokens", 3), ("_short", 2))]]
    both = some.select("_id", "_mark", F.concat(*weak, "_helps").alias("_parts"))
    parts = both.select("_id", "_mark", F.explode("_parts").alias("p")).select("_id", "_mark", "p.s", "p.k", "p.e").distinct()
    parts = stage(parts, "secret-parts")
    secrets = parts.filter(F.col("k") < _IDENTIFIER).select("_id", "_mark", "s", "k", "e", F.explode(F.expr(f"array_union(sequence(greatest(0, s - {scope}) div {scope}, s div {scope}), sequence(e div {scope}, (e + {scope}) div {scope}))")).alias("_cell"))
    # only parts that do not overlap link, so a helper in scope ends just before the secret begins or begins just after it ends
    helpers = parts.filter(F.col("k") >= _IDENTIFIER).select("_id", "_mark", "s", "k", "e", F.explode(F.expr(f"array_distinct(array(s div {scope}, e div {scope}))")).alias("_cell"))
    a, b = secrets.alias("a"), helpers.alias("b")
    close = (F.col("a._cell") == F.col("b._cell")) & (F.col("b.s") < F.col("a.e") + scope) & (F.col("a.s") < F.col("b.e") + scope)
    apart = (F.col("b.e") <= F.col("a.s")) | (F.col("a.e") <= F.col("b.s"))
    fits = reduce(lambda x, y: x | y, [(F.col("a.k") == k) & F.col("b.k").isin(*others) for k, others in COMPLEMENTS.items()])
    met = a.join(b, F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._mark") == F.col("b._mark")) & close & apart & fits, "left_semi")
    return met.groupBy("_id", "_mark").agg(F.sort_array(F.collect_set(F.struct("s", "k", "e"))).alias("added"))


def scan(docs: DataFrame, scope: int = 200, keep: dict[str, str] | None = None) -> DataFrame:
    """``keep`` (name to new name; doc_id) and ``base``, ``all``, ``every``: sorted (s, k, e). ``all`` is without linked spans that meet a base span; ``every`` has them, as they can reach beyond it."""
    keep = keep or {"doc_id": "doc_id"}
    found = linked(docs, scope).select(F.col("_id").alias("_id2"), F.col("_mark").alias("_mark2"), "added")
    base = docs.select(*_key(docs), *[docs[c].alias(n) for c, n in keep.items()], base_spans(text_or_empty(docs)).alias("base"))
    met = base.join(found, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_mark") == F.col("_mark2")), "left")
    added = F.coalesce("added", F.array().cast("array<struct<s:int,k:int,e:int>>"))
    new = let(blocked(F.col("base")), lambda b: F.filter(added, lambda x: ~meets(x, b)))
    return met.select(*keep.values(), "base", F.sort_array(F.concat("base", new)).alias("all"), F.sort_array(F.concat("base", added)).alias("every"))


def report(docs: DataFrame, scope: int = 200) -> DataFrame:
    found = scan(docs, scope)
    return found.select("doc_id", *[count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("all"), KINDS).alias("spans"))


def redact(docs: DataFrame, scope: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark`` (overlapping ones by one each run); n_chars follows. Rows without one, null texts among them, stay as they are."""
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    found = scan(docs, scope, names)
    text = F.col(names["text"])
    done = F.aggregate(
        "every",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)),
    )
    clean = found.select(*names.values(), F.when(F.size("every") > 0, done).otherwise(text).alias("_clean"))
    out = {c: F.col(n) for c, n in names.items()} | {"text": F.col("_clean")}
    if "n_chars" in names:
        out["n_chars"] = F.when(F.col("_clean") != text, F.length("_clean").cast("long")).otherwise(F.col(names["n_chars"]))
    return clean.select(*[v.alias(c) for c, v in out.items()])
