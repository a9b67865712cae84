from pyspark.sql import functions as F

from marginalia.functions import answers as A, frontmatter as FM, text as X
from marginalia.operators import metadata as MD


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first()["x"]


def test_technical_tokens(spark):
    text = "ReCo-MIL 与 F1-score，学习率 1e-4，准确率 87.3%"
    assert one(spark, X.technical_tokens(F.col("t")), t=text) == ["reco-mil", "f1-score", "1e-4", "87.3%"]
    assert one(spark, X.technical_tokens(F.col("t")), t="纯中文") == []


def test_bilingual_terms(spark):
    got = one(spark, X.query_terms(F.col("t"), {"原型": ["prototype"], "分类": ["mil"]}), t="MIL 原型 分类")
    assert got == ["mil", "prototype"]


def test_keyword_query(spark):
    assert one(spark, X.keyword_query(F.col("t")), t='a"b* (C-d) école') == ["a", "b", "c", "d", "ecole"]
    assert one(spark, X.keyword_query(F.col("t")), t='"*^:()') == []


def test_references(spark):
    text = "intro\nReferences are given below.\nReferences\nold\n参考文献.\nstray\n[1] First\nwrapped line\n[2] Second entry\n3. Third"
    section = one(spark, X.references_section(F.col("t")), t=text)
    assert section.startswith("stray")
    assert one(spark, X.reference_entries(F.col("t")), t=section) == ["First wrapped line", "Second entry", "Third"]
    assert one(spark, X.references_section(F.col("t")), t="no list here") is None


def test_title_candidate(spark):
    get = lambda t: one(spark, X.title_candidate(F.col("t")), t=t)
    assert get('A. Author, "A quoted title of a paper," 2020.') == "A quoted title of a paper"
    assert get("Smith J, A long unquoted title of work. Journal, 2019, 12.") == "A long unquoted title of work"
    assert get("Anon., Nature, 2020.") is None


def test_doi_and_year(spark):
    assert one(spark, X.first_doi(F.col("t")), t="doi 10.1234/Ab.c-1 x") == "10.1234/Ab.c-1"
    assert one(spark, X.normalize_doi(F.col("t")), t=" https://doi.org/10.1/ABC.) ") == "10.1/abc"
    assert one(spark, X.first_year(F.col("t")), t="1999 paper. Copyright © 2021") == 2021
    assert one(spark, X.first_year(F.col("t")), t="in 12019 and 2018") == 2018


def test_headings(spark):
    assert one(spark, X.is_heading(F.col("s"), F.col("t")), s="Normal", t="第三章 方法")
    assert one(spark, X.is_heading(F.col("s"), F.col("t")), s="Normal", t="1.2 Scope")
    assert not one(spark, X.is_heading(F.col("s"), F.col("t")), s="Normal", t="1 Scope")
    assert one(spark, X.heading_level(F.col("s"), F.col("t")), s="Normal", t="1.2.3 x") == 3
    assert one(spark, X.heading_level(F.col("s"), F.col("t")), s="Heading 4", t="x") == 4
    assert one(spark, X.clean_heading(F.col("t")), t="绪论\t12") == "绪论"


def test_in_text_citations_and_surnames(spark):
    got = one(spark, X.in_text_citations(F.col("t")), t="as [1, 2] and [3-5] say (Zhou et al., 2024a).")
    assert [c["citation_text"] for c in got] == ["[1, 2]", "[3-5]", "(Zhou et al., 2024a)"]
    assert one(spark, X.surnames(F.col("t")), t="Zhang Wei and Li, O'Neil et al.") == ["zhang", "li", "oneil"]


def test_citation_formats(spark):
    cols = dict(a="", t="T", j="J")
    year = F.lit(None).cast("int")
    got = one(spark, X.format_citation("APA", F.col("a"), F.col("t"), year, F.col("j")), **cols)
    assert got == "匿名 (n.d.). T. J"


def test_markers(spark):
    text = "a[^1^] b[^0^] c[^-2^] d[^3^]"
    assert one(spark, A.clean_markers(F.col("t"), F.lit(2)), t=text) == "a[^1^] b c d"
    report = one(spark, A.marker_report(F.col("t"), F.lit(2)), t=text)
    assert (report["total"], report["valid"], report["removed"], report["verified"]) == (4, 1, 3, False)
    assert one(spark, A.renumber_markers(F.col("t"), F.lit(3), F.lit(10)), t=text) == "a[^11^] b c d[^13^]"


def test_salvaged_json(spark):
    fenced = 'text ```json\n{"items": [{"question": "q"}]}\n``` tail'
    assert one(spark, A.salvage_json(F.col("t")), t=fenced) == '{"items": [{"question": "q"}]}'
    assert one(spark, A.salvage_json(F.col("t")), t='x [1, 2] y') == "[1, 2]"
    assert one(spark, A.salvage_json(F.col("t")), t='{"a": ') is None
    item = "STRUCT<question: STRING>"
    for body in ('[{"question": "q"}]', '{"items": [{"question": "q"}]}', '{"n": 1, "other": [{"question": "q"}]}'):
        assert [r["question"] for r in one(spark, A.payload_items(F.col("t"), item), t=body)] == ["q"]


def test_sub_questions(spark):
    assert one(spark, A.sub_questions(F.col("t")), t='["a", 1, " b "]') == ["a", "b"]
    assert one(spark, A.sub_questions(F.col("t")), t='{"questions": [], "sub_questions": ["x"]}') == ["x"]
    assert len(one(spark, A.sub_questions(F.col("t")), t='["1","2","3","4","5","6"]')) == 5
    assert one(spark, A.sub_questions(F.col("t")), t="not json") is None


def test_message_budget(spark):
    msgs = [("system", "s" * 100)] + [("user", str(i) * 1000) for i in range(4)] + [("user", None)]

    def fit(budget, rows=msgs):
        df = spark.createDataFrame([(rows,)], "ms array<struct<role: string, content: string>>")
        return [tuple(m) for m in df.select(A.fit_messages(F.col("ms"), budget).alias("m")).first().m]
    assert fit(10_000) == msgs
    for budget in (1500, 3900):  # each of the five others gives up a fifth of what is over when its turn comes
        over, want = 4100 - budget, []
        for role, content in msgs[1:]:
            cut = min(max(len(content or "") - 300, 0), over // 5)
            over -= cut
            want.append((role, (content or "")[cut:]))
        assert over > 0 and fit(budget) == [msgs[0], *want[-2:]]
    assert fit(5, []) == [] and fit(5, [("system", "long enough")]) == [("system", "long enough")]
    assert fit(300, [("user", "a" * 400)]) == [("user", "a" * 300)]


def test_titles_and_authors(spark):
    front = ("arXiv preprint 2024\nDeep Prototype Learning for\nWhole Slide Images\nAlice Smith, Tom Jones and Carol White\n"
             "University of Somewhere\nAbstract\nWe propose a method")
    title = one(spark, FM.infer_title(F.col("t")), t=front)
    assert (title["title"], title["line"]) == ("Deep Prototype Learning for Whole Slide Images", 1)
    authors = lambda text, line: tuple(one(spark, FM.infer_authors(F.col("t"), F.lit(line)), t=text))
    assert authors(front, 1) == ("Alice Smith, Tom Jones, Carol White", 3)
    assert authors("x\nAuthor: Ann Lee1; Bo Chen*", 999) == ("Ann Lee, Bo Chen", 1)
    assert authors("see john.doe3@cs.school.edu, j_x@mit.edu and x@mail.com, JOHN.DOE@ac.edu", 999) == ("John Doe, J. X.", 999)
    assert authors("Authors: 12\nAnn Lee, Bo Chen", 999) == (None, 999)
    assert authors("A title here\nAnn B. Lee (a), Bo-\nrough Chen\n1 Introduction\nTom Jones and Ann Ray", 0)[1] == 1
    assert authors(None, 999) == authors("", 0) == (None, 999)
    assert one(spark, FM.title_quality(F.col("t")), t="However this study shows it") < 0


def test_tags(spark):
    assert one(spark, X.clean_tag(F.col("t")), t="深度学习".encode().decode("latin-1")) == "深度学习"
    assert one(spark, X.clean_tag(F.col("t")), t='- "MRI"') == '"MRI'
    tags = one(spark, X.rule_tags(F.col("t"), F.col("t"), F.col("t")), t="A review of deep learning")
    assert tags == ["深度学习", "综述"]


def test_chunk_types(spark):
    assert one(spark, X.chunk_type(F.col("t")), t="Results\n\nABSTRACT of it") == "abstract"
    assert one(spark, X.chunk_type(F.col("t")), t="a\n\nb\n\nmethods") == "paragraph"


def test_strip_takes_the_white_space_of_the_pattern(spark):
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c,) for c in chars], "c STRING").select("c", X.strip(F.concat("c", F.lit("a b"), "c")).alias("new"), F.regexp_replace(
        F.concat("c", F.lit("a b"), "c"), rf"(?U)\A{X.WS}+|{X.WS}+\z", "").alias("old"))
    assert rows.filter("new <> old").count() == 0
    assert "regexp" not in rows.select("new")._jdf.queryExecution().optimizedPlan().toString()


def test_steps_are_computed_once(spark):
    """The expressions name each line list, label, region and heading once; they once held them many times over."""
    d = spark.createDataFrame([(1, "t")], "paper_id BIGINT, text STRING")
    plan = lambda column: d.select(column.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan(FM.infer_authors(F.col("text"), F.lit(0))).count("split(") < 20
    assert plan(X.references_section(F.col("text"))).count("split(") == 1
    assert plan(FM.title_quality(F.col("text"))).count("lower(") == 1
    assert plan(X.chunk_type(F.col("text"))).count("split(") == 1


def test_front_matter_of_one_reading(spark):
    text = "Journal\nA study of deep graph models.\nAuthors: Ann Bell1; Tom Fox*\nAbstract\nbody"
    d = spark.createDataFrame([(1, text), (2, None), (3, "see ann.lee@cs.school.edu")], "paper_id BIGINT, text STRING")
    new = {r["paper_id"]: r for r in MD.front_candidates(d).collect()}
    t = d.withColumn("_t", FM.infer_title(F.col("text"))).withColumn("_a", FM.infer_authors(F.col("text"), F.col("_t.line")))
    for r in t.collect():
        got = new[r["paper_id"]]
        assert (got["title"], got["title_line"], got["authors"], got["authors_line"]) == (*r["_t"], *r["_a"])
    assert new[1]["authors"] == "Ann Bell, Tom Fox" and new[2]["authors_line"] == 999 and new[3]["authors"] == "Ann Lee"


def test_responses_are_parsed_once(spark, monkeypatch):
    from marginalia.operators import qagen as Q
    kept, plain = [], Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df, label: kept.append(label) or plain(df, label))
    response = 'Sure!\n```json\n{"items": [{"question": " q1 ", "ground_truth": "a", "question_type": "factoid", "evidence_quote": "a quote of more than twenty characters"}]}\n```'
    items = Q.raw_items(spark.createDataFrame([(1, response), (2, "none")], "paper_id BIGINT, response STRING"))
    chunks = spark.createDataFrame([(1, 0, "here is a quote of more than twenty characters once")], "paper_id BIGINT, chunk_index INT, content STRING")
    out = Q.accepted_by_quote(items, chunks, spark.createDataFrame([(1, "u")], "paper_id BIGINT, paper_uid STRING"))
    assert kept == ["items"] and "parse_json" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["paper_id"], r["qa_id"], r["question"]) for r in out.collect()] == [(1, "gen-p1-001", "q1")]


def test_payloads_by_shape(spark):
    item = "STRUCT<question: STRING>"
    d = spark.createDataFrame([(1, '[{"question": "a"}, null]'), (2, '{"items": [{"question": "b"}]}'), (3, '{"n": 1, "list": [{"question": "c"}]}'), (4, '{"n": 1}'), (5, None)], "id INT, t STRING")
    got = {r["id"]: [x["question"] for x in r["x"]] for r in d.select("id", A.payload_items(F.col("t"), item).alias("x")).collect()}
    assert got == {1: ["a"], 2: ["b"], 3: ["c"], 4: [], 5: []}
