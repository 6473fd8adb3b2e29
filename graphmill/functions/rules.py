"""Rules as Column expressions, all in the JVM: normal forms, ordered classes, gates and checklists."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, "(?i)https?://\\S+", " ")


def _unmarked() -> tuple[str, str]:
    """Every character whose canonical decomposition is another one and combining marks, and that other one."""
    marked, plain = [], []
    for i in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        x = unicodedata.normalize("NFD", chr(i))
        if len(x) > 1 and all(unicodedata.combining(m) for m in x[1:]):
            marked.append(chr(i))
            plain.append(x[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _unmarked()


def strip_diacritics(c: Column) -> Column:
    """A text of Latin, Greek or Cyrillic letters without their marks; combining marks go. Letters that are not composed, such as ł or ß, stay."""
    return F.regexp_replace(F.translate(c, _MARKED, _PLAIN), "\\p{Mn}+", "")


def host(c: Column) -> Column:
    return F.regexp_extract(c, "^[a-z]+://([^/:?#]+)", 1)


def issue_key(c: Column) -> Column:
    return F.regexp_extract(F.upper(c), "([A-Z][A-Z0-9_]*-[0-9]+)", 1)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def cypher_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def selector_norm(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(F.trim(c)), "\\s+", ""), F.lit('"'), F.lit("'"))


def specificity(c: Column) -> Column:
    """0 test id, 1 id, 2 name, 3 class, 4 anything else."""
    return F.when(c.contains("data-testid"), 0).when(c.startswith("#"), 1).when(c.contains("[name="), 2).when(c.startswith("."), 3).otherwise(4)


def embed_text(fields: list[Column], ticket: Column, most: int = 1000) -> Column:
    """Non-empty fields and the beginning of the ticket's text, joined with blanks."""
    some = lambda c: F.when(c != "", c)
    return F.concat_ws(" ", *(some(c) for c in fields), some(F.left(ticket, F.lit(most))))


def any_in(text: Column, tokens: list[str]) -> Column:
    hit = F.lit(False)
    for x in tokens:
        hit = hit | text.contains(x)
    return hit


def risk_tier(text: Column, critical: list[str], signals: list[list[str]], epic: Column) -> Column:
    """critical by a token; high by two signals of several; else medium."""
    n = epic.cast("int")
    for s in signals:
        n = n + any_in(text, s).cast("int")
    return F.when(any_in(text, critical), "critical").when(n >= 2, "high").otherwise("medium")


def file_flags(content: Column) -> list[Column]:
    """layer, renderable, has_stable_selector and has_route of a file's content."""
    layer = F.when(content.rlike("<form|<button|<nav"), "frontend").when(content.contains("<code"), "backend").otherwise("shared")
    return [layer.alias("layer"), content.contains("<").alias("renderable"), content.rlike('data-testid|id="').alias("has_stable_selector"), content.contains('href="/').alias("has_route")]


def ui_verdict(layer: Column, renderable: Column, selector: Column) -> list[Column]:
    bare = (layer == "shared") & ~renderable
    reason = F.when(layer == "backend", "backend file").when(bare, "no markup").when(~selector, "no stable selector").otherwise("")
    return [((layer != "backend") & ~bare & selector).alias("ui_ok"), reason.alias("reason")]


def word_hit(text: Column, word: str) -> Column:
    """A single word at a word's start with any ending; several words as they stand."""
    return text.rlike(f"\\b{word}\\w*") if word.isalnum() else text.contains(word)


def keyword_class(text: Column, rules: list[tuple[str, list[str]]], otherwise: Column) -> Column:
    """The first class of which a word hits."""
    out = otherwise
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | word_hit(text, w)
        out = F.when(hit, name).otherwise(out)
    return out


def merge_status(s: Column) -> Column:
    return (
        F.when(s.isNull(), "UNKNOWN")
        .when(s.isin("checking", "unchecked", "preparing"), "CHECKING")
        .when(s.isin("can_be_merged", "mergeable"), "MERGEABLE")
        .when(s.isin("cannot_be_merged", "cannot_be_merged_recheck", "conflict"), "CONFLICTED")
        .when(s == "unknown", "UNKNOWN")
        .otherwise("BLOCKED")
    )


#: File endings of each kind of attachment.
ENDINGS = {"images": "png|jpe?g|gif|bmp|webp|svg|tiff?", "media": "mp3|wav|ogg|m4a|flac|mp4|mov|avi|mkv|webm", "documents": "pdf|docx?|xlsx?|pptx?|csv|txt|md|json|xml|ya?ml|log|zip|html?"}


def attachment_classes(names: Column) -> dict[str, Column]:
    """images, media, documents and unsupported: the names of each kind."""
    of = lambda e: F.filter(names, lambda x: F.lower(x).rlike(f"\\.({e})$"))
    out = {k: of(e) for k, e in ENDINGS.items()}
    out["unsupported"] = F.filter(names, lambda x: ~F.lower(x).rlike(f"\\.({'|'.join(ENDINGS.values())})$"))
    return out


def verdict(similarity: Column, semantic: Column, hub: Column, verified: Column) -> list[Column]:
    """verdict, confidence and skip_diagnosis: seen before from 0.72 on, else a pattern, else novel; verified work from 0.80 on needs no diagnosis."""
    seen = similarity >= 0.72
    return [
        F.when(seen, "seen_before").when(semantic | hub, "pattern_match").otherwise("novel").alias("verdict"),
        F.when(seen, similarity).when(semantic, 0.6).when(hub, 0.55).otherwise(0.0).alias("confidence"),
        ((similarity >= 0.80) & verified).alias("skip_diagnosis"),
    ]


def serve_existing(changed: Column, total: Column, few: int, ratio: float) -> Column:
    return (changed == 0) | (changed <= few) | (changed / F.greatest(total, F.lit(1)) < ratio)


def text_norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def _cleaned(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: F.length(x) >= 4)


def capped_dedup(items: Column, most: int) -> Column:
    """Items of four characters or more, the first of each normal form, `most` at most."""
    clean = _cleaned(items)
    keys = F.transform(clean, text_norm)
    return F.slice(F.filter(clean, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1), 1, most)


def merged_dimensions(base: list[str], items: Column, most: int) -> Column:
    """base, then items whose normal form neither holds nor is held by one before it, `most` together."""
    norm = lambda s: " ".join("".join(ch if ch.isalnum() else " " for ch in s.lower()).split())
    start = F.struct(F.array(*(F.lit(x) for x in base)).alias("out"), F.array(*(F.lit(norm(x)) for x in base)).alias("seen"))

    def step(acc: Column, x: Column) -> Column:
        n = text_norm(x)
        known = F.exists(acc["seen"], lambda s: s.contains(n) | n.contains(s)) | (F.size(acc["out"]) >= most)
        return F.when(known, acc).otherwise(F.struct(F.array_append(acc["out"], x).alias("out"), F.array_append(acc["seen"], n).alias("seen")))

    return F.aggregate(_cleaned(items), start, step, lambda acc: acc["out"])


def confidence_score(*evidence: Column) -> Column:
    """Share of items with all their evidence, two digits; an aggregate."""
    all_of = F.lit(True)
    for e in evidence:
        all_of = all_of & e
    return F.round(F.count_if(all_of) / F.greatest(F.count("*"), F.lit(1)), 2)


def remaining_layers(tier: Column, layers: dict[str, list[str]], run: Column) -> Column:
    return F.array_except(F.element_at(F.create_map(*(x for k, v in layers.items() for x in (F.lit(k), F.array(*(F.lit(y) for y in v))))), tier), run)


def completeness(kind: Column, no_schema: Column) -> Column:
    """Share of the fields of its kind that an issue has; 0.79 at most without the schema of an attached table."""
    share = lambda *cols: F.round(sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0)) / float(len(cols)), 2)
    s = F.when(kind == "bug", share("summary", "description", "steps", "expected", "actual", "impact")).when(kind.isin("story", "task", "epic"), share("summary", "description", "criteria", "impact")).otherwise(share("summary", "description", "impact"))
    return F.when(no_schema & (s >= 0.80), 0.79).otherwise(s)


def missing_information() -> Column:
    """Names of what an issue of its kind lacks."""
    kind = F.col("kind")
    story = kind.isin("story", "task", "epic")
    lacks = lambda col, name, cond=F.lit(True): F.when(cond & F.col(col).isNull(), name)
    return F.array_compact(F.array(
        lacks("description", "detailed_description"), lacks("impact", "impact"), lacks("steps", "reproduction_steps", kind == "bug"), lacks("expected", "expected_behavior", kind == "bug"),
        lacks("actual", "actual_behavior", kind == "bug"), lacks("criteria", "acceptance_criteria", story), F.when(story & F.col("no_schema"), "missing_schema"), F.when(~F.col("due"), "due_date"),
    ))


def mutation_gate(killed: Column, total: Column, least: float) -> list[Column]:
    return [F.when(total == 0, 0.0).otherwise(F.round(killed / total, 4)).alias("score"), ((total > 0) & F.coalesce(killed / F.nullif(total, F.lit(0)) >= least, F.lit(False))).alias("passed")]


def done_items(bug: Column, steps: Column, summary: Column) -> Column:
    """One check for each step or criterion, or one to run and observe."""
    some = steps.isNotNull() & (F.size(steps) > 0)
    named = F.transform(steps, lambda s: F.concat(F.when(bug, "Reproduce then confirm resolved: ").otherwise("Acceptance criterion satisfied: "), s))
    return F.when(some, named).otherwise(F.array(F.concat(F.lit("Run the affected path and observe: "), F.coalesce(summary, F.lit("the reported change")))))


def low_confidence(score: Column, least: float, images: Column, read: Column, least_read: int, bare_bug: Column) -> Column:
    return (score < least) | (images & (read < least_read)) | bare_bug


def first_hit(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The first name whose condition holds in a row of the group; an aggregate."""
    return F.coalesce(*(F.max(F.when(c, name)) for name, c in rules), F.lit(otherwise))


def prefix_class(c: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, starts in reversed(rules):
        hit = F.lit(False)
        for s in starts:
            hit = hit | F.lower(c).startswith(s)
        out = F.when(hit, name).otherwise(out)
    return out


def summary_tier(n: Column, small: int, large: int, chunk: int) -> list[Column]:
    """Short texts pass, middling ones are summarised at once, long ones in chunks."""
    return [F.when(n <= small, "pass").when(n <= large, "single").otherwise("map_reduce").alias("mode"), F.when(n <= large, 1).otherwise(F.ceil(n / chunk)).alias("chunks")]
