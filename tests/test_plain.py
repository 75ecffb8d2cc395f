"""Queries that SQL can't express against plain Python, over the whole small tables."""

import hashlib
import json
import re

import pytest

import __spark_entry__ as entry
from evidora.functions import vocab
from evidora.operators import documents
from evidora.plans import catalogue_documents, catalogue_records, catalogue_search
from evidora.plans import views as V

BLANKS = " \t\n\x0b\f\r"


def java(pattern, flags=0):
    """A pattern with classes of ASCII, as the engine's have them."""
    return re.compile(pattern.replace(r"\d", "[0-9]").replace(r"[^\s", f"[^{BLANKS}").replace(r"[0-9][[0-9]\s", f"[0-9][[0-9]{BLANKS}").replace(r"\s", f"[{BLANKS}]").replace(r"\w", "[A-Za-z0-9_]"), flags)


def rows(spark, small, name, *key):
    got = entry.queries()[name](spark, small).collect()
    found = {tuple(r[k] for k in key): r for r in got}
    assert len(found) == len(got) > 0
    return found


def texts(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def collapse(s):
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", s)).strip(BLANKS)


IMAGE = re.compile(r"(?i)!\[[^\]]*\]\([^)]*\)|!\[[^\]]*\]|![^!\n]+\.(?:png|jpg|jpeg|gif)[^!\n]*!")
PHONE = re.compile(rf"(?<![A-Za-z0-9_])(?:\+?[0-9][0-9{BLANKS}().-]{{7,}}[0-9])(?![A-Za-z0-9_])")


def masked(name, s):
    pattern, mark = next((p, m) for n, _, p, m in vocab.MASKS if n == name)
    return (PHONE if name == "phone" else java(pattern)).sub(mark, s)


def clean(s):
    s = (s or "").replace("\r", "\n")
    s = re.sub(r"[*_#>`~]{1,3}", " ", s)
    s = re.sub(r"\[([^\]|]+)\|[^\]]+\]", r"\1", s)
    s = IMAGE.sub(" ", re.sub(r"\{[a-z]+(:[^}]*)?\}", " ", s))
    for name, *_ in vocab.MASKS:
        s = masked(name, s)
    return collapse(s)


def test_clean_text(spark, small):
    got = rows(spark, small, "clean_text", "doc_id")
    for i, t in texts(spark, small).items():
        assert got[i,]["cleaned"] == clean(t)


def test_mask_phone(spark, small):
    name = next(c for c in entry.queries()["mask_phone"](spark, small).columns if c != "doc_id")
    got, hit = rows(spark, small, "mask_phone", "doc_id"), 0
    for i, t in texts(spark, small).items():
        assert got[i,][name] == masked("phone", t)
        hit += "[phone]" in got[i,][name]
    assert hit


def test_first_sentence_with_cue(spark, small):
    got = rows(spark, small, "first_sentence_with_cue", "issue_key")
    cues = vocab.FIX_CUES + vocab.ROOT_CAUSE_CUES
    for r in V.view(spark, small, V.DEFECTS).collect():
        parts = [p.strip(BLANKS) for p in re.split(rf"(?<=[.!?])[{BLANKS}]+|\n+", r["description"] or "")]
        assert got[r["issue_key"],]["sentence"] == next((p for p in parts if len(p) > 12 and any(c in p.lower() for c in cues)), "")


def test_rich_text_flatten(spark, small):
    got = rows(spark, small, "rich_text_flatten", "conv_id", "turn")
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        assert got[r["conv_id"], r["turn"]]["plain"] == (r["text"] or "") + "\n"


def normalized(q):
    s = (q or "").strip(BLANKS)
    for short, long in vocab.CONTRACTIONS.items():
        s = re.sub(rf"\b{short}\b", long, s, flags=0 if short[0] == "I" else re.I)
    filler = re.compile("|".join(vocab.FILLERS), re.I | re.A)
    for _ in range(3):
        s = filler.sub("", s).strip(BLANKS)
    s = re.sub(rf"[{BLANKS}]{{2,}}", " ", s).strip(BLANKS)
    colon = re.compile(r"\s*(include[s]?|are|is|consist[s]? of|contain[s]?)?\s*:+\s*\Z", re.I | re.A)
    if colon.search(s):
        s = colon.sub("", s).strip(BLANKS)
        s = f"What are the {s[:1].lower()}{s[1:]}?" if s and not s.endswith("?") else s
    s = s[:1].upper() + s[1:]
    return s or q


def test_query_normalize(spark, small):
    got = rows(spark, small, "query_normalize", "qid")
    for r in V.view(spark, small, V.QUESTIONS).collect():
        assert got[r["qid"],]["normalized"] == normalized(r["question"])


def test_relative_times(spark, small):
    got = rows(spark, small, "relative_times", "event_id")
    events = spark.read.parquet(f"{small}/events.parquet").collect()
    now = max(e["ts"] for e in events).replace(microsecond=0)
    half = lambda a, b: (2 * a + b) // (2 * b)
    for e in events:
        sec = int((now - e["ts"].replace(microsecond=0)).total_seconds())
        m = half(sec, 60)
        h = half(m, 60)
        d = half(h, 24)
        w = half(d, 7)
        want = "just now" if sec < 45 else f"{m}m ago" if m < 60 else f"{h}h ago" if h < 24 else f"{d}d ago" if d < 7 else f"{w}w ago" if w < 5 else e["ts"].strftime("%b ") + str(e["ts"].day)
        assert got[e["event_id"],]["ago"] == want


def test_section_chunks(spark, small):
    """Which sections are kept, whole or in parts; parts keep order, length and every word."""
    found = entry.queries()["section_chunks"](spark, small).collect()
    parts = {}
    for r in sorted(found, key=lambda r: (r["source_file"], r["island"], r["part"])):
        parts.setdefault((r["source_file"], r["island"]), []).append(r)
    dotted = lambda x: sum(c in ".·…" for c in x) > 0.4 * len(x) or re.search(rf"^[{BLANKS}.·…\-_]{{5,}}[{BLANKS}]*[0-9]{{0,4}}[{BLANKS}]*$|^[0-9]{{1,4}}[{BLANKS}]*$", x)
    kept = set()
    for s in catalogue_documents._sections(spark, small).collect():
        lines = [x.strip(BLANKS) for x in re.split(r"\r?\n", s["content"]) if x.strip(BLANKS)]
        toc = not lines or sum(bool(dotted(x)) for x in lines) / len(lines) > 0.7
        if s["element_type"] != "TEXT" or toc or len(re.sub("#+ ", "", s["content"]).strip(BLANKS)) < 50:
            continue
        kept.add((s["source_file"], s["island"]))
        body, own = s["content"].strip(BLANKS), parts[s["source_file"], s["island"]]
        assert [r["part"] for r in own] == list(range(len(own))) and {r["page_info"] for r in own} == {str(s["page"]) if s["page"] == s["page_end"] else f"{s['page']}-{s['page_end']}"}
        if len(body) <= vocab.SECTION_LIMIT:
            assert [(r["chunk_type"], r["display"]) for r in own] == [("section_full", body)]
            continue
        at = end = 0
        for r in own:
            assert r["chunk_type"] == "section_part" and 0 < len(r["display"]) <= vocab.PART_SIZE
            at = body.index(r["display"], max(at, end - vocab.PART_OVERLAP - 2))
            assert not body[end:at].strip()
            end = at + len(r["display"])
        assert not body[end:].strip()
    assert kept == set(parts)


def test_splitter_takes_linear_time_without_blanks():
    import time

    def run(n):
        began = time.perf_counter()
        assert "".join(p[-1] for p in documents.split_recursively("x" * n, 1000, 100))
        return time.perf_counter() - began

    run(10_000)
    assert run(400_000) < 40 * 4 * run(10_000) + 0.2


def test_table_chunks(spark, small):
    got = {}
    for r in entry.queries()["table_chunks"](spark, small).collect():
        got.setdefault((r["source_file"], r["page"]), []).append(r)
    tables = V.view(spark, small, catalogue_documents._TABLES).collect()
    assert len(got) == len({(t["source_file"], t["page"]) for t in tables}) > 0
    for t in tables:
        cells = [c.strip() for c in t["content"].split("\n")[2].strip("|").split("|")]
        own = {r["asset_type"]: r for r in got[t["source_file"], t["page"]] if r["display"] == t["content"]}
        assert own["TABLE_FRAGMENT"]["embed_text"] == t["content"][:500]
        assert own["TABLE_ROW"]["embed_text"] == "This table lists feature flag configuration options for the Feature flags section. It has 1 rows with columns: flag | level | product.\nRow: " + " — ".join(cells)


def test_page_split(spark, small):
    """Pages of five elements: texts between tables run together, tables stay as they are."""
    got = {}
    for r in sorted(entry.queries()["page_split"](spark, small).collect(), key=lambda r: r["ord"]):
        got.setdefault((r["source_file"], r["page"]), []).append((r["element_type"], r["content"]))
    pages = {}
    for r in sorted(V.view(spark, small, V.ELEMENTS).collect(), key=lambda r: r["pdf_page_number"]):
        pages.setdefault((r["source_file"], (r["pdf_page_number"] - 1) // 5), []).append((r["pdf_page_number"], r["content"]))
    for key, own in pages.items():
        want, lines, block = [], "\n\n".join(c for _, c in sorted(own)).split("\n"), []
        runs, text = [], []
        for line in [*lines, None]:
            piped = line is not None and re.fullmatch(r"[ \t]*\|.*\|[ \t]*", line)
            if piped:
                block.append(line)
                continue
            if block:
                if len(block) > 1:
                    runs += [("TEXT", "\n".join(text)), ("TABLE", "\n".join(block).strip())]
                    text = []
                else:
                    text += block
                block = []
            if line is not None:
                text.append(line)
        runs.append(("TEXT", "\n".join(text)))
        for kind, s in runs:
            s = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", s).strip() if kind == "TEXT" else s
            if s:
                want.append((kind, s))
        assert got.get(key, []) == want


def test_issue_chunks(spark, small):
    """Five kinds of texts put together from the normalised records."""
    cut = lambda s, n: s if len(s) <= n else s[: n - 1].rstrip(BLANKS) + "…"
    got = rows(spark, small, "issue_chunks", "chunk_id")
    want = {}
    for r in catalogue_records.all_records(spark, small).collect():
        r = {k: (v if v is not None else "") for k, v in r.asDict().items()}
        said = cut(" \n".join(x for x in r["comments_blob"].split("\n") if x).strip(BLANKS), 800)
        of = {
            "problem_chunk": collapse(" ".join([r["summary"], r["problem_text"], r["symptom_text"], r["error_signature"]])),
            "root_cause_chunk": " ".join([r["root_cause_extracted"], r["root_cause_raw"], "", r["key_findings"]]),
            "fix_chunk": " ".join([r["fix_applied_extracted"], r["workaround_extracted"], r["resolution_description_raw"], r["solution_text"]]),
            "comment_insight_chunk": " ".join([r["key_findings"], said]),
            "full_context_chunk": " ".join([f"[{r['issue_key']}]", r["summary"], r["problem_text"], "Root cause: " + r["root_cause_extracted"], "Fix: " + r["fix_applied_extracted"], "Status: " + r["status"], "Priority: " + r["priority"], "Components: " + ", ".join(r["components"]), "Fix pattern: " + r["fix_pattern"]]),
        }
        for kind, t in of.items():
            if len(t.strip(BLANKS)) >= 8:
                want[f"{r['issue_key']}::{kind}",] = cut(t.strip(BLANKS), 1500)
    assert {k: r["text"] for k, r in got.items()} == want


REST = ["defect_normalize", "key_lookup_similar", "reading_context"]


@pytest.mark.parametrize("name", REST)
def test_the_rest_gives_the_same_rows_whatever_the_layout(spark, small, name):
    """Run twice, with other numbers of partitions: results don't hang on the order of rows."""
    digest = lambda df: hashlib.sha256("\n".join(sorted(df.toJSON().collect())).encode()).hexdigest()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = entry.queries()[name](spark, small)
    assert json.loads(first.toJSON().first()) and len(first.columns) > 1
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        again = digest(entry.queries()[name](spark, small))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert digest(first) == again


def test_answers_and_prompts_of_every_result(spark, small):
    results = {r["qid"] for r in catalogue_search._results(spark, small).select("qid").distinct().collect()}
    said = rows(spark, small, "answers", "qid")
    assert {q for q, in said} == results
    for r in said.values():
        assert [h for h in re.findall(r"(?m)^## (.*)$", r["answer"])] == ["Root Causes", "How Similar Defects Were Fixed Earlier", "Suggested Fix Steps", "Similar Fixed Defects"]
    prompts = entry.queries()["evidence_prompts"](spark, small).collect()
    assert {r["qid"] for r in prompts} >= results
