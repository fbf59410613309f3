"""Column builders: estimators, percentiles, hash orders, canonical texts, spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nul_sha(*parts: str | Column) -> Column:
    """SHA-256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws(NUL, *[c(p) for p in parts]), 256)


def pass_at_k(n: str | Column, correct: str | Column, k: int) -> Column:
    """Unbiased pass@k: 1 - C(n - c, k) / C(n, k), as a running product; null unless 0 <= c <= n and 1 <= k <= n."""
    n, correct = c(n).cast("int"), c(correct).cast("int")
    product = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * (n - correct - i) / (n - i))
    valid = (correct >= 0) & (correct <= n) & (n >= k)
    return F.when(valid & (n - correct < k), 1.0).when(valid, F.lit(1.0) - product)


def mcnemar_exact(b: str | Column, d: str | Column) -> Column:
    """Exact two-sided McNemar p-value of b and d discordant pairs, in double."""
    b, d = c(b).cast("int"), c(d).cast("int")
    total, low = b + d, F.least(b, d)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    tail = F.aggregate(
        F.when(low >= 1, F.sequence(F.lit(1), low)).otherwise(F.array().cast("array<int>")), start,
        lambda acc, i: F.struct((acc["term"] * (total - i + 1) / i).alias("term"), (acc["sum"] + acc["term"] * (total - i + 1) / i).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), F.lit(2.0) * tail * F.pow(F.lit(0.5), total)))


def nearest_rank(x: str | Column, p: float) -> Column:
    """sorted[ceil(p n) - 1]; null for no rows."""
    if isinstance(x, str):
        return F.expr(f"percentile_disc({p}) within group (order by {x})")
    held = F.array_sort(F.collect_list(x))
    return F.try_element_at(held, F.greatest(F.lit(1), F.ceil(F.lit(p) * F.size(held))).cast("int"))


def fudged_rank(x: str | Column, p: float) -> Column:
    """sorted[int(p n + 0.999999) - 1], clamped; null for no rows."""
    held = F.array_sort(F.collect_list(c(x)))
    n = F.size(held)
    return F.when(n > 0, F.element_at(held, F.greatest(F.lit(1), F.least(n, (F.lit(p) * n + F.lit(0.999999)).cast("int")))))


def interpolated(x: str | Column, p: float) -> Column:
    """Linear interpolation at (n - 1) p."""
    return F.percentile(c(x), p)


def hash_order(prefix: str, key: str | Column) -> Column:
    return F.sha2(F.concat(F.lit(prefix), c(key).cast("string")), 256)


def hash_index(n: int, *parts: str | Column) -> Column:
    """A portable pseudo-random integer in [0, n): 15 hex digits of a SHA-256."""
    digits = F.substring(F.sha2(F.concat_ws("|", *[c(p).cast("string") for p in parts]), 256), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint") % n


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is null or 0."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def sorted_distinct(x: str | Column) -> Column:
    return F.array_sort(F.array_distinct(c(x)))


def histogram(keys: str | Column, values: str | Column) -> Column:
    """A map sorted by key from (key, value) rows of a group."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(c(keys).alias("key"), c(values).alias("value")))))


# canonical texts ------------------------------------------------------------------------------


def unix_lines(x: str | Column) -> Column:
    return F.regexp_replace(c(x), r"\r\n?", "\n")


def canonical_declaration(x: str | Column) -> Column:
    """Unix line ends, no trailing space or ``:=``; null if nothing is left."""
    text = F.regexp_replace(unix_lines(x), r"\s+\z", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\s*:=\s*\z", ""), r"\s+\z", "")
    return F.when(text != "", text)


def completion_of(proof: str | Column) -> Column:
    """What follows ``by`` and white space; null if the proof has another form or nothing follows."""
    return F.nullif(F.regexp_extract(c(proof), r"(?s)\Aby\s+(.+)\z", 1), F.lit(""))


def indent(x: str | Column, by: int) -> Column:
    """Indent lines that hold more than white space."""
    return F.regexp_replace(c(x), r"(?m)^(?=.*\S)", " " * by)


def canonical_proof(x: str | Column) -> Column:
    """(canonical, transformation) of a proof: ``by`` proofs stay, equation blocks, where fields and terms are wrapped; null if empty."""
    src = F.regexp_replace(unix_lines(x), r"\A\s+|\s+\z", "")
    is_by = src.rlike(r"\Aby(\s|\z)")
    equations = F.concat(F.lit("by\n  exact (\n"), indent(F.concat(F.lit("@fun\n"), indent(src, 2)), 4), F.lit("\n  )"))
    fields = F.regexp_replace(F.regexp_replace(src, r"\Awhere", ""), r"\A\s+|\s+\z", "")
    where = F.concat(F.lit("by\n  exact {\n"), indent(fields, 4), F.lit("\n  }"))
    term = F.concat(F.lit("by\n  exact (\n"), indent(src, 4), F.lit("\n  )"))

    def made(text: Column, kind: str) -> Column:
        return F.struct(text.alias("proof"), F.lit(kind).alias("transformation"))

    return (
        F.when((src == "") | src.rlike(r"\Aby\s*\z") | src.rlike(r"\Awhere\s*\z"), None)
        .when(is_by, made(src, "none")).when(src.startswith("|"), made(equations, "equations-to-fun-exact"))
        .when(src.rlike(r"\Awhere\s"), made(where, "where-to-structure-exact")).otherwise(made(term, "term-to-exact"))
    )


def transport(x: str | Column) -> Column:
    """Unix line ends, trailing blanks of the whole text off."""
    return F.regexp_replace(unix_lines(x), "[ \t\n]+\\z", "")


#: Fixed value: the instruction that opens a proof request.
INSTRUCTION = "/- Complete the proof below.\nReturn only Lean code continuing after `by`; do not use `sorry` or `admit`. -/"


def proof_request(declaration: str | Column) -> Column:
    return F.concat(F.lit(INSTRUCTION + "\n"), c(declaration), F.lit(" := by\n  "))


def prompt(preamble: str | Column, declaration: str | Column) -> Column:
    """The text a model continues."""
    return F.concat(c(preamble), F.lit("\n\n"), proof_request(declaration))


def reconstructed(preamble: str | Column, declaration: str | Column, candidate: str | Column) -> Column:
    return F.concat(prompt(preamble, declaration), transport(candidate), F.lit("\n"))


def target_exact(candidate: str | Column, target: str | Column) -> Column:
    return transport(candidate) == transport(target)


def retryable(exit_code: Column, stderr: Column, tool_events: Column, model_violation: Column, markers: Sequence[str]) -> Column:
    """Only infrastructure failures are tried again: no tool events, no wrong model, a failing exit and a known marker."""
    return (tool_events == 0) & ~model_violation & (exit_code != 0) & stderr.rlike("|".join(f"(?:{m})" for m in markers))


def shortened(x: str | Column, keep: int = 500) -> Column:
    """Long messages as head, digest and tail."""
    x = c(x)
    return F.when(F.char_length(x) <= 2 * keep, x).otherwise(F.concat(F.left(x, F.lit(keep)), F.lit("…"), F.sha2(x, 256), F.lit("…"), F.right(x, F.lit(keep))))


def alias_key(x: str | Column) -> Column:
    return F.regexp_replace(F.lower(c(x)), r"[^\p{L}\p{N}]", "")


def text_sizes(x: str | Column) -> Column:
    """(chars, lines, utf8_bytes)."""
    x = c(x)
    lines = F.char_length(x) - F.char_length(F.replace(x, F.lit("\n"))) + 1
    return F.struct(F.char_length(x).alias("chars"), lines.alias("lines"), F.octet_length(x).alias("utf8_bytes"))


# spans ----------------------------------------------------------------------------------------


def valid_span(s: str | Column) -> Column:
    s = c(s)
    positive = (s["start"]["line"] > 0) & (s["start"]["column"] > 0) & (s["end"]["line"] > 0) & (s["end"]["column"] > 0)
    return F.coalesce(s.isNotNull() & positive & (s["start"] < s["end"]), F.lit(False))


def position_offset(source: str | Column, position: Column) -> Column:
    """Characters before a (line, column) position, both from 1; null outside the text."""
    lines = F.split(c(source), "\n", -1)
    line, col = position["line"], position["column"]
    before = F.aggregate(F.slice(lines, F.lit(1), F.greatest(line - 1, F.lit(0))), F.lit(0), lambda acc, x: acc + F.char_length(x) + 1)
    inside = (line >= 1) & (line <= F.size(lines)) & (col >= 1) & (col <= F.char_length(F.try_element_at(lines, line)) + 1)
    return F.when(inside, before + col - 1)


def source_slice(source: str | Column, span: Column) -> Column:
    a, b = position_offset(source, span["start"]), position_offset(source, span["end"])
    return F.when(a < b, F.substring(c(source), a + 1, b - a))


def substitute_spans(source: str | Column, edits: str | Column) -> Column:
    """Replace several spans (start, end: offsets from 0, text), from the last to the first; null if two overlap."""
    e = F.array_sort(c(edits))
    apart = F.forall(F.zip_with(F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))), F.slice(e, F.lit(2), F.greatest(F.size(e) - 1, F.lit(0))), lambda x, y: x["end"] <= y["start"]), lambda x: x)
    done = F.aggregate(F.reverse(e), c(source), lambda acc, x: F.concat(F.substring(acc, F.lit(1), x["start"]), x["text"], F.substring(acc, x["end"] + 1, F.char_length(acc))))
    return F.when(apart, done)


# classification -------------------------------------------------------------------------------


def first_rule(rules: Sequence[tuple[Column, str]], fallback: str) -> Column:
    """The first rule that holds; exactly one fallback, the last."""
    out = F.lit(fallback)
    for condition, label in reversed(list(rules)):
        out = F.when(condition, label).otherwise(out)
    return out


def keyword_tags(haystack: Column, tags: dict[str, Sequence[str]]) -> Column:
    """Sorted tags of which a keyword occurs in the lower-cased haystack."""
    low = F.lower(haystack)

    def any_of(words: Sequence[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w.lower())
        return out

    found = F.array(*[F.when(any_of(words), F.lit(tag)) for tag, words in sorted(tags.items())])
    return F.array_sort(F.filter(found, lambda x: x.isNotNull()))


def result_category(text: Column, probe_category: Column, timed_out: Column, exit_code: Column, output: Column) -> Column:
    """Empty text, then a failed probe's category, then a timeout, then exit code and error lines decide."""
    failed_line = F.coalesce(output.rlike(r"(?m)^.*: error:"), F.lit(False))
    return (
        F.when(transport(text) == "", "empty_candidate").when(probe_category.isNotNull(), probe_category).when(timed_out, "verifier_timeout")
        .when((exit_code == 0) & ~failed_line, "verified").otherwise("lean_rejected")
    )


def label_mask(prompt_ids: Column, completion_ids: Column, eos: int) -> Column:
    """(input_ids, labels): prompt labels are -100, the end token is learned."""
    ids = F.concat(prompt_ids, completion_ids, F.array(F.lit(eos)))
    return F.struct(ids.alias("input_ids"), F.concat(F.array_repeat(F.lit(-100), F.size(prompt_ids)), completion_ids, F.array(F.lit(eos))).alias("labels"))


def padded(x: Column, width: Column, fill: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(fill), width - F.size(x)))


def canonical_json(*columns: str) -> Column:
    """Compact JSON with sorted keys, nulls kept."""
    return F.to_json(F.struct(*[F.col(x) for x in sorted(columns)]), {"ignoreNullFields": "false"})
