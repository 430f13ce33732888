"""One surviving record for each group of duplicates, built from consistent bundles.

Fields that depend on one another form a *bundle* and are taken whole from one member where one has
them all. Options of different bundles are bound to each other by *functional dependencies*: each
declares the values it needs of some attributes, and chosen options must agree on them. In
``survivors`` the chosen record determines which columns are lacking, and so which options of the
other bundles may stand beside it; in ``golden_records`` the place, the extraction and the content of a
record must be of one source type, and its title of the script that its language bundle names.
Trust in a member is a vector; ``search`` finds the most trusted consistent bundles by branch and bound:

* branch: of each bundle, and each combination of values that enters a dependency, the most trusted
  members are options. That reduction is an aggregation, so a family with any number of members is a
  row of bounded size (at most 5 records and 9 fillers) before it reaches one task;
* bound: the best trust that the bundles still open can add, criterion by criterion.

Defined cases: null, empty and blank values are the same and never chosen over a filled one; null
hashes match nothing; ties go to the smaller book_id; repeated rows count once; families without
members give no row; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.tables import current_rows

#: Columns that a survivor without them takes from another member.
FILLED = ("filename", "title", "source_relpath", "extractor", "quality_expected_language", "quality_detected_script")

#: The order of each criterion, best first; anything else counts as missing.
REVIEW = {"approved": 3, "approved_auto": 3, "approved_manual": 3, "approved_lease": 3, "pending_review": 2, "rejected": 1}
QUALITY = {"ok": 3, "warn": 2, "quarantine": 1}
SOURCE = {"txt": 3, "html": 3, "docx": 3, "epub": 3, "pdf": 2, "doc": 2, "ibooks": 2}

#: The same columns in bundles of dependent ones.
DEPENDENT = (("filename", "source_relpath"), ("title",), ("extractor",), ("quality_expected_language", "quality_detected_script"))

#: Bundles of dependent columns of a whole record, and what each bundle is bound by, if anything: its source
#: type, the script it names, or the script its title is written in.
BUNDLES = {
    "place": (("json_path", "filename", "source_root", "source_path", "source_relpath", "source_ext", "source_type"), "source_type"),
    "extraction": (("extractor", "pdf_pipeline", "pdf_ocr_strategy", "conversion_status"), "source_type"),
    "content": (("source_hash", "content_hash", "text_hash", "text_simhash", "total_pages", "size_bytes"), "source_type"),
    "title": (("title",), "title"),
    "language": (("language", "quality_expected_language", "quality_detected_script"), "script"),
    "quality": (("quality_status", "quality_reasons_json", "quality_warnings_json", "quality_metrics_json"), None),
    "review": (("review_status", "review_required", "review_route", "reviewed_by", "reviewed_at", "review_note"), None),
}


def _plain(column: str) -> Column:
    """The value in lower case without outer white space; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(F.col(column).cast("string"), r"(?U)^\s+|\s+$", "")), F.lit(""))


def _rank(column: str, order: dict[str, int]) -> Column:
    rank = F.lit(0)
    for value, n in order.items():
        rank = F.when(_plain(column) == value, n).otherwise(rank)
    return rank


def members(families: DataFrame, books: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The distinct (family_key, member) rows: books whose content_hash or text_hash is the family's.

    Two equi-joins on the hashes; empty and blank hashes are treated as null and equal nothing.
    """
    columns = columns or [c for c in books.columns if c != "updated_at"]
    family = current_rows(families, ["family_key"]).select("family_key", _plain("content_hash").alias("__c"), _plain("text_hash").alias("__t"))
    rank = [_rank("review_status", REVIEW).alias("__review"), _rank("quality_status", QUALITY).alias("__quality"), _rank("source_type", SOURCE).alias("__source")]
    filled = sum((_plain(c).isNotNull().cast("int") for c in FILLED), F.lit(0)).alias("__filled")
    book = current_rows(books, ["book_id"]).select(*columns, *rank, filled, F.col("updated_at").alias("__at"), _plain("content_hash").alias("__bc"), _plain("text_hash").alias("__bt"))
    by_content = family.join(book, F.col("__c") == F.col("__bc"))
    by_text = family.join(book, F.col("__t") == F.col("__bt")).where(~F.coalesce(F.col("__c") == F.col("__bc"), F.lit(False)))
    return by_content.unionByName(by_text).drop("__c", "__t", "__bc", "__bt")


def survivors(families: DataFrame, books: DataFrame) -> DataFrame:
    """family_key, field_name, book_id: the surviving record, and who fills its blank columns.

    Options for the record are the members that are best by one criterion at least, whatever the others
    say; the survivor must reach the family's best value of each, alone. Fillers are the most trusted
    members that have a column, and those that have all of a bundle's columns.
    """
    rows = members(families, books, ["book_id", *FILLED, "content_hash", "text_hash"])
    at = F.unix_micros(F.coalesce(F.col("__at"), F.lit("0001-01-01").cast("timestamp_ntz")).cast("timestamp"))
    criteria = [F.col(c).cast("long") for c in ("__review", "__quality", "__source", "__filled")] + [at]
    rows = rows.select("family_key", "book_id", F.array(*criteria).alias("trust"), F.array(*[_plain(c).isNotNull() for c in FILLED]).alias("has"))
    alike = rows.groupBy("family_key", "trust").agg(F.count("*").alias("same"), F.min_by("has", "book_id").alias("has"), F.min("book_id").alias("book_id"))
    option = F.struct("book_id", "trust", "same", "has")
    records = alike.groupBy("family_key").agg(F.sum("same").alias("members"), F.array_distinct(F.array(*[F.max_by(option, F.struct(F.col("trust")[i], "trust")) for i in range(5)])).alias("records")).where("members > 1")
    sets = sorted({x for bundle in DEPENDENT for x in [bundle, *[(c,) for c in bundle]]})
    order = F.struct("trust", F.hash("book_id"), "book_id")
    has = lambda columns: functools.reduce(lambda a, b: a & b, [F.col("has")[FILLED.index(c)] for c in columns])
    fillers = rows.groupBy("family_key").agg(*[F.max_by(F.when(has(x), F.struct("book_id", "trust")), F.when(has(x), order)).alias(f"f{i}") for i, x in enumerate(sets)])
    ready = records.join(fillers, "family_key").select("family_key", "records", F.array(*[f"f{i}" for i in range(len(sets))]).alias("fillers"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, own, others in zip(pdf["family_key"], pdf["records"], pdf["fillers"]):
                options = record_options([(r["book_id"], tuple(r["trust"]), r["same"], tuple(r["has"])) for r in own]) + filler_options({x: (f["book_id"], tuple(f["trust"])) for x, f in zip(sets, others) if f is not None})
                found = search([o[:3] for o in options], alone="record")
                out += [(key, name, book) for i in sorted(found.values()) for name, book in options[i][3]]
            yield pd.DataFrame(out, columns=["family_key", "field_name", "book_id"])

    return ready.mapInPandas(solve, "family_key string, field_name string, book_id string")


def record_options(records: list[tuple[str, tuple, int, tuple]]) -> list[tuple]:
    """(bundle, needed values, trust, rows) of each possible record; members that no criterion tells apart are out."""
    return [("record", {c: bool(x) for c, x in zip(FILLED, has)}, (*map(int, trust), *[0] * 7), [("record", book)] if same == 1 else []) for book, trust, same, has in records]


def filler_options(fillers: dict[tuple, tuple[str, tuple]]) -> list[tuple]:
    """(bundle, needed values, trust, rows): for each bundle and each set of its columns that the record may lack, who fills them.

    The trust prefers more columns, then one member for all of them, then trusted members.
    """
    options = []
    for bundle in DEPENDENT:
        for n in range(len(bundle) + 1):
            for lacking in itertools.combinations(bundle, n):
                needs = {c: c not in lacking for c in bundle}
                choices = [[(c, fillers[(c,)]) for c in lacking if (c,) in fillers]]
                if len(lacking) > 1 and lacking in fillers:
                    choices.append([(c, fillers[lacking]) for c in lacking])
                for chosen in choices:
                    trust = tuple(sum(int(t[k]) for _, (_, t) in chosen) for k in range(5))
                    whole = int(bool(chosen) and len({book for _, (book, _) in chosen}) == 1)
                    options.append(("+".join(bundle), needs, (*[0] * 5, len(chosen), whole, *trust), [(c, book) for c, (book, _) in chosen]))
    return options


def search(options: list[tuple[str, dict, tuple]], alone: str | None = None) -> dict[str, int]:
    """Branch and bound: the option of each bundle with the greatest total trust, needed values agreeing.

    ``options`` are (bundle, needed values by attribute, trust); the result has the index of each bundle's
    option. A bundle none of whose options agrees with the others stays out, which counts as no trust at
    all. Trust is compared as the tuple of sums; ties go to the option that comes first. The bundle
    ``alone`` comes first, and only an option of it that reaches its best value of every criterion is
    a branch; without one nothing is chosen.
    """
    by: dict[str, list[int]] = {}
    for i, (bundle, _, _) in enumerate(options):
        by.setdefault(bundle, []).append(i)
    width = len(options[0][2]) if options else 0
    best_of = {b: tuple(max(options[i][2][k] for i in own) for k in range(width)) for b, own in by.items()}
    if alone is not None:
        by[alone] = [i for i in by.get(alone, []) if options[i][2] == best_of[alone]]
        if not by[alone]:
            return {}
    order = sorted(by, key=lambda b: (b != alone, not any(options[i][1] for i in by[b]), b))
    add = lambda a, b: tuple(x + y for x, y in zip(a, b))
    zero = (0,) * width
    rest = [zero]
    for bundle in reversed(order):
        rest.append(add(rest[-1], tuple(max(0, x) for x in best_of[bundle])))
    rest.reverse()
    best: list = [None, {}]

    def go(depth: int, values: dict, total: tuple, chosen: dict[str, int]) -> None:
        if best[0] is not None and add(total, rest[depth]) <= best[0]:
            return  # even the most trusted remaining bundles don't beat what is known
        if depth == len(order):
            best[:] = [total, dict(chosen)]
            return
        bundle = order[depth]
        for i in sorted(by[bundle], key=lambda i: options[i][2], reverse=True):
            needs = options[i][1]
            if all(values.get(k, v) == v for k, v in needs.items()):
                go(depth + 1, values | needs, add(total, options[i][2]), chosen | {bundle: i})
        if bundle != alone:
            go(depth + 1, values, total, chosen)

    go(0, {}, zero, {})
    return best[1]


def _script(column: str) -> Column:
    """arabic or latin where a text has letters of one of them only; else null."""
    arabic, latin = F.col(column).rlike("[\\u0600-\\u06ff]"), F.col(column).rlike("\\p{IsLatin}")
    return F.when(arabic & ~latin, "arabic").when(latin & ~arabic, "latin")


def golden_records(families: DataFrame, books: DataFrame) -> DataFrame:
    """family_key, bundle, kind, book_id, values (JSON): the whole bundles of each family's record."""
    columns = sorted({c for names, _ in BUNDLES.values() for c in names} | {"book_id"})
    rows = members(families, books, columns)
    epoch = F.unix_seconds(F.coalesce(F.col("__at"), F.lit("1970-01-01").cast("timestamp_ntz")).cast("timestamp"))
    script = _plain("quality_detected_script")
    kinds = {"source_type": _plain("source_type"), "script": F.when(script.isin("arabic", "latin"), script), "title": _script("title"), None: F.lit(None).cast("string")}
    options = []
    for name, (names, kind) in BUNDLES.items():
        filled = sum((_plain(c).isNotNull().cast("int") for c in names), F.lit(0))
        options.append(F.struct(F.lit(name).alias("bundle"), kinds[kind].alias("kind"), filled.alias("filled"), F.to_json(F.struct(*names)).alias("values")))
    each = rows.select("family_key", "book_id", F.struct("__review", "__quality", "__source", epoch.alias("at")).alias("member"), F.explode(F.array(*options)).alias("o")).where("o.filled > 0")
    trust = F.struct("member.__review", "member.__quality", F.col("o.filled").alias("filled"), "member.__source", "member.at")
    order = F.struct(trust, F.hash("book_id"), "book_id")
    best = each.groupBy("family_key", "o.bundle", "o.kind").agg(F.max_by(F.struct("book_id", "o.values", trust.alias("trust")), order).alias("best"))
    best = best.select("family_key", "bundle", "kind", "best.book_id", "best.values", F.array(*[F.col("best.trust")[n].cast("long") for n in ("__review", "__quality", "filled", "__source", "at")]).alias("trust"))
    ready = best.groupBy("family_key").agg(F.array_sort(F.collect_list(F.struct("bundle", "kind", "trust", "book_id", "values"))).alias("options"))
    attribute = {name: {"title": "script"}.get(kind, kind) for name, (_, kind) in BUNDLES.items()}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, own in zip(pdf["family_key"], pdf["options"]):
                found = search([(o["bundle"], {attribute[o["bundle"]]: o["kind"]} if o["kind"] is not None else {}, tuple(int(x) for x in o["trust"])) for o in own])
                out += [(key, own[i]["bundle"], own[i]["kind"], own[i]["book_id"], own[i]["values"]) for i in sorted(found.values())]
            yield pd.DataFrame(out, columns=["family_key", "bundle", "kind", "book_id", "values"])

    return ready.mapInPandas(solve, "family_key string, bundle string, kind string, book_id string, values string")
