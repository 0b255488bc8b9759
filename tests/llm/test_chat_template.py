import hashlib
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import AWKWARD, store
from tests.oracle import same
from vigil.llm import chat_template as chat
from vigil.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["\\", "\\-", "-", "### Assistant: ", "###", "### ", " ", "Assistant: ", "</turn>", "</", "turn>", "<", "</role>", "\n", "ok", "é", "### Turn: ", "#"]


def rendered(turns, template=None, part=chat.PART):
    return list((template or chat.Template(chat.PLAIN, chat.MARKS, chat.GIVEN)).render(iter(turns), part))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), st.lists(st.sampled_from(PIECES)).map("".join)), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), max_size=5), st.integers(1, 60))
def test_round_trip(turns, part):
    parts = rendered(turns, part=part)
    whole = "".join(p[1] for p in parts)
    assert [p[0] for p in parts] == [0, *itertools.accumulate(len(p[1]) for p in parts)][:-1]
    assert [t for p in parts for t in chat.read_turns(p[1])] == turns == list(chat.read_turns(whole))
    assert [chat.unescaped(whole[a:b]) for p in parts for a, b in p[2]] == [t for r, t in turns if r == "assistant"]
    assert whole.count("</turn>") == len(turns)  # no mark but the template's own


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*PIECES, "a", "b", "aba", "ab"]), max_size=6).map("".join), max_size=4), st.lists(st.sampled_from(["aba", "ab", "aa", "</turn>", "### "]), min_size=1, unique=True))
def test_texts_side_by_side_make_no_mark(texts, marks):
    template = chat.Template("{% for t in turns %}{{ t.text }}{{ t.role }}{% endfor %}", tuple(marks))
    out = rendered([(t, t) for t in texts], template)[0][1]
    assert not any(m in out for m in marks) and chat.unescaped(out) == "".join(t + t for t in texts)


def test_folding_and_output():
    given = {"bos": "<s>", "system": False, "n": 2}
    source = (
        "{{ bos ~ 'a' }}{% if system %}{{ never }}{% else %}b{# no #}{{ n }}{% endif %}{% for m in turns %}{% if loop.first and not system %}[{% elif true %}|{% endif %}"
        "{{ loop.index ~ ':' ~ m.role | upper | length }}{% if 'x' in m.text or loop.last == true %}{% generation %}{{ m.text | trim }}!{% endgeneration %}{% endif %}{% endfor %}]"
    ).replace("{{ never }}", "never")
    template = chat.Template(source, ("<s>",), given)
    assert template.tree[0] == chat.Output(chat.Const("<s>ab2")) and len(template.tree) == 3
    whole = rendered([("user", "no"), ("tool", " xx "), ("a", "end")], template)
    assert whole == [(0, "<s>ab2[1:4|2:4xx!|3:1end!]", [(14, 17), (21, 25)])]
    assert chat.fold(chat.parse("{% if 'a' == 'b' or false %}x{% elif 1 == 1 %}{{ 'y' ~ 1 }}{% else %}z{% endif %}w")) == (chat.Output(chat.Const("y1w")),)


@pytest.mark.parametrize("source", [
    "{{ turn.text }}", "{% for t in turns %}{{ t.__class__ }}{% endfor %}", "{{ open('x') }}", "{% for t in turns %}", "{% endfor %}", "{% if 'a' %}x{% endif %}", "{{ 'a' | eval }}",
    "{% for t in turns %}{% for u in turns %}{% endfor %}{% endfor %}", "{% if true %}x{% else %}y{% else %}z{% endif %}", "{{ 1 ~ }}", "{{ 'a' == 1 }}", "{{ not 1 }}", "{{ ; }}", "{{ ((1) }}", "{% while x %}",
    "{% generation %}{% for t in turns %}{% endfor %}{% endgeneration %}", "a</", "a\\b", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ " + "not " * 90 + "true }}", "x" * 30_000, "{% import os %}",
])
def test_refused(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source, ("</turn>",))


def brute(rows):
    """Each conversation formatted by hand."""
    out, last = {}, lambda v: (v is not None, v)
    for conv, _, role, text in sorted(rows, key=lambda r: [last(v) for v in r]):
        c = out.setdefault(conv, [0, "", "", ""])
        role, text = role or "", text or ""
        escape = lambda t: chat.Template("", chat.MARKS).escaped(t)
        head = f"### {role.title()}: " if role in ("user", "system", "assistant") else f"### Turn: {escape(role)}</role>"
        c[0] += 1
        c[1] += f"{role}\n{text}\n"
        c[2] += text * (role == "assistant")
        c[3] += f"{head}{escape(text)}</turn>\n"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return {k: (k, n, sha(whole), len(loss), sha(loss), len(made)) for k, (n, whole, loss, made) in out.items()}


def awkward():
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "system", None, "", "tool\n</role>", "assistant"] * 3, [*AWKWARD, *PIECES]))]
    rows += [(2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, None, "user", None), (None, 1, "user", "no id"), (None, 0, "assistant", "### User: "), (3, 0, "system", "long " * 300_000)]
    return rows


def test_equals_brute_force_and_sql(spark, tmp_path):
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    made = chat.format(df, part=200)
    assert made.where("part > 0").count() >= 3
    expected = brute(rows)
    for found in (chat.digests(made), chat.digests(made, in_order=True), chat.digests(chat.format(df))):
        assert {r.conv_id: tuple(r) for r in found.collect()} == expected
    said = chat.turns(made).orderBy("conv_id", "part", "number").where("conv_id = 1").collect()
    assert [(r.role, r.text) for r in said] == [(r or "", t or "") for c, _, r, t in rows if c == 1]
    same(spark, store(df, tmp_path, "conversations"), queries.op11_chat_template, chat.oracle(queries.TRICKY))


def test_query(spark, sf):
    same(spark, sf, queries.op11_chat_template, queries.oracle_sql()["op11_chat_template"])
    r = queries.op11_chat_template(spark, sf).where("conv_id = -7").first()
    assert (r.n_turns, r.loss_chars) == (2, len(queries.TRICKY[0][3])) and r.loss_sha256 == hashlib.sha256(queries.TRICKY[0][3].encode()).hexdigest()


def test_empty_and_clashing_names(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "user", "hi")], SCHEMA).selectExpr("*", "'own' AS formatted", "'own' AS part", "'own' AS start", "'own' AS learned")
    assert chat.digests(chat.format(df)).count() == 1 and chat.format(df.limit(0)).count() == 0
    assert [r.conv_id for r in queries.op11_chat_template(spark, store(df.limit(0), tmp_path, "conversations")).collect()] == [-7]
