"""Checks of sentence records: issue codes with paths, quality flags, draft rules.

A record is a row (sentence_id, page, sentence, curated_sentence, tokens, values,
entities, ner_tags, schema_version, mapping_provenance).  Issues are an array of
(code, path) in a fixed order, made inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.vocabulary import VALUES, strip, vocab
from spanforge.operators.spans import coded, let
from spanforge.operators.structure import TEXT, WHOLE, Fields, Items, Nullable, shape_issues, walk

ENTITY = "struct<start:int,end:int,text:string,label:string,color:string>"
RECORD = (
    f"sentence_id int, page int, sentence string, curated_sentence string, tokens array<string>, values array<string>, entities array<{ENTITY}>, "
    "ner_tags array<string>, schema_version string, mapping_provenance struct<method:string,status:string,config_id:string>"
)
ISSUE = "array<struct<code:string,path:string>>"
HEX = "^#[0-9A-Fa-f]{6}$"
VERSIONS = ["0.1", "1.0"]


def issue(code: str, path: Column | str) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(path) if isinstance(path, str) else path).alias("path"))


def when(condition: Column, code: str, path: Column | str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), issue(code, path))


def present(*issues: Column) -> Column:
    return F.array_compact(F.array(*issues))


def known(label: Column) -> Column:
    return label.isin(*VALUES)


def indexed(field: str, i: Column, rest: str = "") -> Column:
    return F.concat(F.lit(f"$.{field}["), i, F.lit("]" + rest))


def effective_sentence(curated: Column, sentence: Column) -> Column:
    """The curated sentence if there is one that differs from the sentence and is not empty."""
    return F.coalesce(F.when((curated != sentence) & (curated != ""), curated), sentence)


def entity_issues(entities: Column, sentence: Column) -> Column:
    def of(e: Column, i: Column) -> Column:
        start, end = e.getField("start"), e.getField("end")
        outside = (start < 0) | (end <= start) | (end > F.length(sentence))
        differs = F.substr(sentence, start + 1, end - start) != e.getField("text")
        return present(
            when(~known(e.getField("label")), "unknown_label", indexed("entities", i, ".label")),
            when(~e.getField("color").rlike(HEX), "invalid_color", indexed("entities", i, ".color")),
            when(outside, "invalid_entity_offset", indexed("entities", i)),
            when(~outside & differs, "entity_text_mismatch", indexed("entities", i)),
        )

    return F.flatten(F.transform(entities, of))


def tag_parts(tag: Column) -> Column:
    """(tag, prefix, label, valid) of a tag; O and tags without a hyphen have no prefix."""
    split = tag.contains("-") & (tag != "O")
    prefix, label = F.when(split, F.substring_index(tag, "-", 1)), F.when(split, F.regexp_extract(tag, r"(?s)^[^-]*-(.*)$", 1))
    return F.struct(tag.alias("tag"), prefix.alias("prefix"), label.alias("label"), F.coalesce(split & prefix.isin("B", "I") & known(label), F.lit(False)).alias("valid"))


def bio_issues(tags: Column) -> Column:
    """Unknown tags, and I tags that follow no tag of their label.

    The tag before counts as it is written, even if its label or prefix is
    unknown; O and tags without a hyphen do not.
    """

    def details(parts: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            before = F.get(parts, i - 1)
            follows = F.coalesce(before.getField("prefix").isin("B", "I") & (before.getField("label") == p.getField("label")), F.lit(False))
            return present(
                when((p.getField("tag") != "O") & ~p.getField("valid"), "invalid_bio_tag", indexed("ner_tags", i)),
                when(p.getField("valid") & (p.getField("prefix") == "I") & ~follows, "invalid_bio_transition", indexed("ner_tags", i)),
            )

        return F.flatten(F.transform(parts, one))

    # most sequences have nothing to report, which the tags' numbers tell without looking at a text twice
    odd = let(coded(tags), lambda t: F.exists(F.transform(t, lambda c, i: (c == 0) | ((c > 1) & (c.bitwiseAND(F.lit(1)) == 1) & (F.shiftright(F.coalesce(F.get(t, i - 1), F.lit(0)), 1) != F.shiftright(c, 1)))), lambda x: x))
    return F.when(odd, let(F.transform(tags, tag_parts), details)).otherwise(F.array().cast(ISSUE))


def bio_labels(tags: Column) -> Column:
    """Labels that the tags name, once each."""
    numbers = F.array_distinct(F.transform(F.filter(coded(tags), lambda c: c > 1), lambda c: F.shiftright(c, 1)))
    return F.transform(numbers, lambda k: F.get(vocab(), k - 1))


def same_set(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: (F.size(F.array_except(x.getField("a"), x.getField("b"))) == 0) & (F.size(F.array_except(x.getField("b"), x.getField("a"))) == 0))


def record_issues(c=F.col) -> Column:
    """All issues of a record row, or of what c gives for its columns' names, in the contract's order."""
    curated = F.when(c("curated_sentence") != c("sentence"), c("curated_sentence"))
    version = F.coalesce(c("schema_version"), F.lit(VERSIONS[0]))
    mapping = c("mapping_provenance")
    return F.concat(
        present(when(strip(curated) == "", "invalid_curated_sentence", "$.curated_sentence")),
        entity_issues(c("entities"), effective_sentence(c("curated_sentence"), c("sentence"))),
        present(
            when(c("sentence_id") < 1, "invalid_type", "$.sentence_id"),
            when(c("page") < 1, "invalid_type", "$.page"),
            when(~version.isin(*VERSIONS), "unsupported_schema_version", "$.schema_version"),
            when(mapping.getField("method") == "", "invalid_type", "$.mapping_provenance.method"),
            when(~mapping.getField("status").isin("pending_review", "approved"), "invalid_mapping_status", "$.mapping_provenance.status"),
        ),
        F.array_compact(F.transform(c("values"), lambda v, i: when(~known(v), "unknown_label", indexed("values", i)))),
        present(when(F.size(c("tokens")) != F.size(c("ner_tags")), "token_tag_length_mismatch", "$.ner_tags")),
        bio_issues(c("ner_tags")),
        present(
            when(~same_set(c("values"), F.transform(c("entities"), lambda e: e.getField("label"))), "value_entity_mismatch", "$.values"),
            when(~same_set(c("values"), bio_labels(c("ner_tags"))), "bio_value_mismatch", "$.ner_tags"),
        ),
    )


#: What each code means to a reader.
MESSAGES = {
    "invalid_json": "can't be read as JSON",
    "invalid_document": "a list of records is needed",
    "invalid_type": "missing, unknown, or of another type than the record's shape has",
    "invalid_curated_sentence": "a curated sentence needs text",
    "unknown_label": "no label of the vocabulary",
    "invalid_color": "a colour is # and six hexadecimal digits",
    "invalid_entity_offset": "start and end leave the sentence or enclose nothing",
    "entity_text_mismatch": "the sentence has another text between start and end",
    "unsupported_schema_version": "versions are " + " and ".join(VERSIONS),
    "invalid_mapping_status": "a mapping is pending_review or approved",
    "token_tag_length_mismatch": "each token has one tag",
    "invalid_bio_tag": "a tag is O, or B or I with a label",
    "invalid_bio_transition": "an I tag follows a tag of its label",
    "value_entity_mismatch": "values and the labels of entities differ",
    "bio_value_mismatch": "values and the labels of tags differ",
}


def message(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair]), code), F.lit(""))


def with_issues(records: DataFrame) -> DataFrame:
    """Records that have an issue, with all of theirs.

    Issues are made in a generator, which the optimiser neither copies into a
    filter nor evaluates twice.
    """
    return records.withColumn("issues", F.explode(F.filter(F.array(record_issues()), lambda x: F.size(x) > 0)))


def canonical_json(*columns: str) -> Column:
    """Record columns as JSON without null fields; a curated sentence equal to the sentence is left out."""
    curated = F.when(F.col("curated_sentence") != F.col("sentence"), F.col("curated_sentence"))
    return F.to_json(F.struct(*[curated.alias(c) if c == "curated_sentence" else F.col(c) for c in sorted(columns)]))


_NAMED = Fields({"start": WHOLE, "end": WHOLE, "text": TEXT, "label": TEXT}, {"color": Nullable(TEXT)})
_MAPPING = Fields({"method": TEXT, "status": TEXT}, {"config_id": Nullable(TEXT)})
#: The shape of a record; types are strict: no number for a text, no text for a number.
SHAPE = Fields(
    {"sentence_id": WHOLE, "page": WHOLE, "sentence": TEXT},
    {"curated_sentence": Nullable(TEXT)},
    {"tokens": Items(TEXT), "values": Items(TEXT), "entities": Items(_NAMED), "ner_tags": Items(TEXT)},
    {"schema_version": TEXT, "mapping_provenance": Nullable(_MAPPING)},
)


def structural(json_text: Column) -> Column:
    """Issues of the shape of a record in JSON, at any depth: no object, keys that lack or are too many, wrong types."""
    return shape_issues(json_text, SHAPE)


def checked(record: Column) -> Column:
    """All issues of a parsed record: those of its shape, or, if it has none, those of the contract's rules."""

    def rules(r: Column) -> Column:
        return record_issues(lambda name: r.getField(name))

    unreadable = F.array(issue("invalid_json", "$"))
    shape = F.when(record.isNull(), unreadable).otherwise(walk(record, SHAPE, F.lit("$")))
    typed = F.try_variant_get(record, "$", "struct<" + ",".join(x.replace(" ", ":", 1) for x in RECORD.split(", ")) + ">")
    return let(shape, lambda found: F.when(F.size(found) > 0, found).otherwise(let(typed, rules)))


# --- quality flags ---------------------------------------------------------------------

LIMITS = {"minimum_characters": 15, "maximum_characters": 500, "maximum_tokens": 100}
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFD]"


def quality_flags(limits: dict[str, int] | None = None) -> Column:
    """Array of (code, severity): sentence flags, token flags, contract issues, open colours."""
    limits = LIMITS | (limits or {})
    text = F.coalesce(F.when(F.col("curated_sentence") != "", F.col("curated_sentence")), F.col("sentence"))
    flag = lambda condition, code, severity="warning": F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    words = F.size(F.filter("tokens", lambda t: t.rlike(r"^[\p{L}\p{N}]+$")))
    opened = (F.col("mapping_provenance.status") == "pending_review") | F.exists("entities", lambda e: F.startswith(e.getField("label"), F.lit("#")))

    def of_trimmed(trimmed: Column) -> Column:
        """The text is trimmed once, not for each condition."""
        empty, length = F.coalesce(trimmed == "", F.lit(True)), F.length(trimmed)
        return F.array_compact(
            F.array(
                flag(empty, "empty_sentence", "error"),
                flag(~empty & (length < limits["minimum_characters"]), "unusually_short_sentence"),
                flag(~empty & (length > limits["maximum_characters"]), "unusually_long_sentence"),
                flag(~empty & text.rlike(CONTROL), "suspicious_character"),
                flag(~empty & ~F.right(trimmed, F.lit(1)).isin(*".!?;:"), "likely_sentence_boundary_error"),
                flag(words <= 1, "single_word_sentence"),
                flag(F.size("tokens") > limits["maximum_tokens"], "too_many_tokens"),
            )
        )

    of_text = let(strip(text), of_trimmed)
    of_contract = F.transform(record_issues(), lambda i: F.struct(i.getField("code").alias("code"), F.lit("error").alias("severity")))
    return F.concat(of_text, of_contract, F.array_compact(F.array(flag(opened, "unresolved_color_mapping"))))


def quality_report(records: DataFrame, *keys: str) -> DataFrame:
    """Rows and flagged rows, and how often each flag occurs, by keys."""
    # records are judged once: each distinct array of flags is counted, and both figures are read off the counts
    kinds = records.select(*keys, quality_flags().alias("flags")).groupBy(*keys, "flags").agg(F.count(F.lit(1)).alias("n"))
    one = F.struct(F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("severity"))
    flags = F.coalesce("flags", F.array().cast("array<struct<code:string,severity:string>>"))
    each = kinds.select(*keys, "n", F.size(flags).alias("size"), F.explode(F.concat(flags, F.array(one))).alias("f"))
    sums = each.groupBy(*keys, "f.code", "f.severity").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("m"))
    of = Window.partitionBy(*keys)
    total = lambda c: F.max(F.when(F.col("code").isNull(), F.col(c))).over(of)
    return sums.withColumns({"records": total("n"), "flagged": total("m")}).filter("code is not null").drop("m")


# --- drafts, scopes, people, citations ---------------------------------------------------


def draft_is_coherent() -> Column:
    """Raw drafts: entities lie in the sentence with their text and a colour, tags are O or B/I with a hex."""
    inside = F.forall("entities", lambda e: (e.getField("start") >= 0) & (e.getField("end") > e.getField("start")) & (e.getField("end") <= F.length("sentence")) & (F.substr(F.col("sentence"), e.getField("start") + 1, e.getField("end") - e.getField("start")) == e.getField("text")) & e.getField("color").rlike("^#[0-9A-F]{6}$"))
    tags = F.forall("ner_tags", lambda t: t.rlike("^(O|[BI]-#[0-9A-F]{6})$"))
    return inside & tags & (F.size("tokens") == F.size("ner_tags"))


def normalise_draft(records: DataFrame) -> DataFrame:
    """Entities' colour becomes upper case, from the colour or else the label; labels become null; tags' hex upper case."""
    colour = lambda e: F.upper(F.coalesce(e.getField("color"), e.getField("label")))
    entities = F.transform("entities", lambda e: F.struct(e.getField("start").alias("start"), e.getField("end").alias("end"), e.getField("text").alias("text"), F.lit(None).cast("string").alias("label"), colour(e).alias("color")))
    tags = F.transform("ner_tags", lambda t: F.when(t == "O", t).otherwise(F.concat(F.substring(t, 1, 2), F.upper(F.substring(t, 3, 100)))))
    good = F.forall("entities", lambda e: colour(e).rlike("^#[0-9A-F]{6}$"))
    return records.withColumns({"valid": F.coalesce(good, F.lit(False)), "entities": entities, "ner_tags": tags})


def scope_is_valid(full: Column, pages: Column) -> Column:
    """A full scope has no pages; a partial one has sorted distinct positive pages."""
    sorted_ = (F.size(pages) > 0) & (pages == F.array_sort(F.array_distinct(pages))) & F.forall(pages, lambda p: p > 0)
    return F.when(full, F.coalesce(F.size(pages), F.lit(0)) <= 0).otherwise(F.coalesce(sorted_, F.lit(False)))


# Roles of people in their order, and kinds of cited items.
ROLES = ["annotator", "curator", "data_owner"]
ITEM_TYPES = ["article", "book", "chapter", "paper-conference", "report", "webpage"]


def person_issues() -> Column:
    """Rules for (person_id, name, roles, email, orcid, active_curator)."""
    c = F.col
    return present(
        when(~c("person_id").rlike("^PERSON-[A-Z0-9]+$"), "invalid_person_id", "$.person_id"),
        when(strip(c("name")) == "", "missing_name", "$.name"),
        when((c("email") != "") & ~c("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "invalid_email", "$.email"),
        when((c("orcid") != "") & ~c("orcid").rlike(r"^\d{4}-\d{4}-\d{4}-[\dX]{4}$"), "invalid_orcid", "$.orcid"),
        when((F.size("roles") == 0) | (F.size(F.array_except("roles", F.array(*[F.lit(r) for r in ROLES]))) > 0), "invalid_role", "$.roles"),
        when(c("active_curator") & ~F.array_contains("roles", "curator"), "curator_role_missing", "$.active_curator"),
    )


def roles_in_order(roles: Column) -> Column:
    return F.array_intersect(F.array(*[F.lit(r) for r in ROLES]), roles)


def citation_issues() -> Column:
    """Rules for (title, creators, item_type, issued_year, undated, citation, reference, not_findable_reason).

    A source is dated or undated, not both; it has a reference or a reason why none is to be found.
    """
    c = F.col
    dated = c("issued_year").isNotNull()
    reference, reason = F.coalesce(c("reference"), F.lit("")) != "", F.coalesce(c("not_findable_reason"), F.lit("")) != ""
    return present(
        when(F.coalesce(strip(c("title")), F.lit("")) == "", "missing_source_title", "$.title"),
        when(F.size("creators") == 0, "missing_source_creator", "$.creators"),
        when(~c("item_type").isin(*ITEM_TYPES), "invalid_item_type", "$.item_type"),
        when(dated == F.coalesce(c("undated"), F.lit(False)), "year_or_undated", "$.issued_year"),
        when(~c("issued_year").between(1000, 9999), "invalid_year", "$.issued_year"),
        when(F.coalesce(strip(c("citation")), F.lit("")) == "", "missing_citation", "$.citation"),
        when(~reference & ~reason, "missing_findability", "$.reference"),
    )


def readiness_issues() -> Column:
    """Release readiness of document metadata rows; one code for each missing part.

    Columns: title, creators, citation, reference, not_findable_reason,
    citation_validated, annotators, method, extractor, extractor_version,
    extracted_at, sentence_approval_required, review_complete, reviewed_at, colors
    (array of (hex, label, status, reason)), colors_confirmed, confirmed_by,
    confirmed_at, resources.
    """
    c = F.col
    blank = lambda x: F.coalesce(F.trim(c(x)) == "", F.lit(True))
    none = lambda x: F.coalesce(F.size(x), F.lit(0)) <= 0
    no = lambda x: ~F.coalesce(c(x), F.lit(False))
    colors = lambda i: F.concat(F.lit("$.colors["), i, F.lit("]"))
    checks = [
        (blank("title"), "missing_source_title"),
        (none("creators"), "missing_source_creator"),
        (blank("citation"), "missing_citation"),
        (blank("reference") & blank("not_findable_reason"), "missing_findability"),
        (blank("reference") & ~blank("not_findable_reason"), "source_not_findable"),
        (no("citation_validated"), "citation_not_validated"),
        (none("annotators"), "missing_original_annotator"),
        (blank("method"), "missing_extraction_method"),
        (blank("extractor"), "missing_extractor"),
        (blank("extractor_version"), "missing_extractor_version"),
        (c("extracted_at").isNull(), "missing_extraction_date"),
        (no("sentence_approval_required"), "sentence_approval_not_required"),
        (no("review_complete"), "annotation_review_incomplete"),
        (c("reviewed_at").isNull(), "missing_review_date"),
        (none("colors"), "missing_color_mapping"),
    ]
    per_color = F.flatten(
        F.transform(
            "colors",
            lambda x, i: present(
                when(x.getField("status") == "pending", "color_pending_review", colors(i)),
                when((x.getField("status") == "approved") & x.getField("label").isNull(), "approved_color_missing_label", colors(i)),
                when((x.getField("status") == "ignored") & F.coalesce(x.getField("reason") == "", F.lit(True)), "ignored_color_missing_reason", colors(i)),
            ),
        )
    )
    tail = [
        (~none("colors") & no("colors_confirmed"), "color_mapping_unconfirmed"),
        (~no("colors_confirmed") & blank("confirmed_by"), "missing_color_confirmation_person"),
        (~no("colors_confirmed") & c("confirmed_at").isNull(), "missing_color_confirmation_date"),
        (none("resources"), "missing_annotations_resource"),
    ]
    make = lambda rows: present(*[when(cond, code, "$") for cond, code in rows])
    return F.concat(make(checks), F.coalesce(per_color, F.array().cast(ISSUE)), make(tail))


def severity(code: Column) -> Column:
    return F.when(code == "source_not_findable", "warning").otherwise("error")


# Citation codes that do not block curation.
CITATION_CODES = ["missing_source_title", "missing_source_creator", "missing_citation", "missing_findability", "citation_not_validated"]


def blocking(issues: DataFrame) -> DataFrame:
    """Errors that block curation: all but those about the citation."""
    return issues.filter((severity(F.col("code")) == "error") & ~F.col("code").isin(*CITATION_CODES))
