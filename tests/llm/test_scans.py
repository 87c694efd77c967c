"""Secrets, tokenization, decontamination, markup and conversations against brute force and exact round trips."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest
import sentencepiece

from reviewlake.llm import automaton, chat, decontamination, markup, pieces, secrets
from tests.llm.conftest import SF

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets_of(text):
    t = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(spans)


def test_secrets(rough, documents, nothing):
    for docs in (rough, documents):
        rows = docs.select("doc_id", "text").collect()
        got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan(docs).collect())
        expected = Counter()
        for r in rows:
            spans = secrets_of(r.text)
            said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
            expected[r.doc_id, *(sum(k == j for _, k, _ in spans) for j in range(3)), hashlib.sha256(said.encode()).hexdigest()] += 1
        assert got == expected
    assert secrets.scan(nothing).count() == 0


def test_secret_fuzz_and_extra_kinds():
    r, scanner = random.Random(1), secrets.Scanner()
    parts = ["token", "secret", "passWord", "api_key", "=", ":", " ", '"', "a", "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "\n", "é", ",", "x"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    for t, spans in zip(texts, scanner.spans([t.encode() for t in texts])):
        at = lambda i, t=t: len(t[:i].encode())
        assert [s for s in spans if s[1] < 3] == [(at(a), k, at(b)) for a, k, b in secrets_of(t)]
    text = b"x ghp_" + b"gZ" * 20 + b" -----BEGIN RSA PRIVATE KEY----- eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"
    assert [secrets.KINDS[k][0] for _, k, _ in scanner.spans([text])[0]] == ["github", "pem", "jwt"]


@pytest.mark.parametrize("piece", ["eyJ", "token=", "AKIA", "gh", "xoxb-", "sk_live_", "-----BEGIN RSA ", "a" * 23 + "g", "secret:"])
def test_secret_scan_takes_time_in_proportion(piece):
    """Runs that begin matches again and again and end none: four times the text takes no sixteen times the time."""
    scanner, took = secrets.Scanner(), []
    for size in (20_000, 80_000):
        text = (piece * (size // len(piece)) + ".eyJ").encode()
        began = time.perf_counter()
        scanner.spans([text])
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * max(took[0], 0.1)


@pytest.mark.parametrize("pattern", ["ab*c", "(a|bc){2,3}d?", "[a-c]+x", "(?i:Ab)c+"])
def test_automaton_is_the_regex(pattern):
    auto, r = automaton.Automaton([pattern], search=False), random.Random(2)
    for _ in range(500):
        t = "".join(r.choice("abcdxAB") for _ in range(r.randint(0, 12)))
        longest = max((e for e in range(1, len(t) + 1) if re.fullmatch(pattern, t[:e])), default=None)
        got = next(automaton.matches(auto, t.encode(), 0, len(t)), None)
        assert (got[1] if got and got[0] == 0 else None) == longest


def test_bpe_ids_are_the_librarys(documents, rough, nothing):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    for docs in (documents, rough):
        encoded = pieces.encode(docs)
        got = Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect())
        assert got == Counter((r.doc_id, tuple(sp.encode(r.text or ""))) for r in docs.select("doc_id", "text").collect())
    back = {r.doc_id: r.back for r in pieces.decode(pieces.encode(documents), out="back").collect()}
    assert back == {r.doc_id: r.text for r in documents.collect()}
    for docs in (rough, documents):
        once = pieces.encode(docs, decoded="back")
        assert sorted(map(str, once.collect())) == sorted(map(str, pieces.decode(pieces.encode(docs), out="back").collect()))
    assert pieces.encode(nothing).count() == 0


def test_unigram_ids_are_the_librarys():
    """The same pieces and scores read as a unigram model: small scores, so that the library's 32-bit sums are exact."""
    model = pieces.read_model(pieces.default_path()) | {"type": pieces.UNIGRAM}
    own = pieces.Pieces(model)
    r = random.Random(3)
    words = ["the", "ing", "on", "é", "漢", "\n", "abc", "er", "tion", "q", "12"]
    for _ in range(300):
        word = "▁" + "".join(r.choice(words) for _ in range(r.randint(1, 4)))[:14]
        best = [0.0] + [float("-inf")] * len(word)
        for end in range(1, len(word) + 1):
            for begin in range(max(0, end - own.longest), end):
                piece = word[begin:end]
                score = own.score[own.ids[piece]] if piece in own.ids else own.least if end - begin == 1 else float("-inf")
                best[end] = max(best[end], best[begin] + score)
        flat, sizes = own.lattice([word])
        assert sum(own.score[i] if i >= 0 else own.least for i in flat) == best[-1] and len(flat) == sizes[0]


def test_token_fuzz():
    sp, own = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path()), pieces.Pieces(pieces.read_model(pieces.default_path()))
    r = random.Random(3)
    parts = ["  ", "   ", " ", "a", "the", "ing", "\n", "\t", "é", "漢", "🙂", "123", "'", "...", "er", "\x00", "x" * 60, " " * 40]
    texts = [None, ""] + ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    offsets, ids = own.encode(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == sp.encode(t or "")
        assert own.decode(ids[offsets[i] : offsets[i + 1]].tolist()) == (t or "")


def test_decontamination(spark, documents, rough, nothing):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: re.findall(r"\w+", r.text.lower()) for r in bench.collect()}
    expected = set()
    for r in documents.collect():
        text = " " + " ".join(re.findall(r"\w+", r.text.lower())) + " "
        expected |= {(r.doc_id, i) for i, w in items.items() if " " + " ".join(w) + " " in text}
    found = decontamination.contaminated(documents, bench).collect()
    assert expected and expected <= {(r.doc_id, r.item_id) for r in found}
    assert {(r.doc_id, r.item_id) for r in found if r.exact} == expected
    clean = {r.doc_id for r in decontamination.drop_contaminated(documents, bench).collect()}
    assert clean == {r.doc_id for r in documents.collect()} - {r.doc_id for r in found}
    assert decontamination.contaminated(rough, bench).count() == 0 and decontamination.contaminated(nothing, bench).count() == 0
    assert decontamination.contaminated(documents, bench.limit(0)).count() == 0
    assert decontamination.drop_contaminated(rough, bench).columns == rough.columns


def test_other_values_in_the_same_template(spark, monkeypatch):
    item = "Anna buys 12 apples for 3 dollars each and sells 5 apples to Boris. How many dollars does Anna keep after paying 7 dollars of rent to Boris?"
    swap = lambda a, b, *n: item.replace("Anna", a).replace("Boris", b).replace("12", n[0]).replace("3 d", f"{n[1]} d").replace("5 a", f"{n[2]} a").replace("7", n[3])
    mixed = "Clara buys 40 apples for 8 dollars each and sells 9 apples to Dora. How many dollars does Emil keep after paying 2 dollars of rent to Fritz?"
    docs = spark.createDataFrame([(1, "Well. " + item), (2, swap("Clara", "Dora", "40", "8", "9", "2")), (3, "An unrelated text about apples and dollars that Anna keeps."), (4, mixed)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.exact) for r in decontamination.contaminated(docs, bench).collect()}
    assert got[1] == (7, True) and got[2] == (7, False) and 3 not in got
    monkeypatch.setattr(decontamination, "MEETS", 1)
    assert {r.doc_id: (r.item_id, r.exact) for r in decontamination.contaminated(docs, bench).collect()} == got


def test_marks_lose_no_item(spark, rough):
    """The hash join of marks against a comparison of every text with every item: other values, other case, cut items, short ones, items that share most windows, hot texts, rough rows."""
    r = random.Random(12)
    words = "the of Anna Boris Paris 12 7 30 apples kg how many buys sells when each rents".split()
    items = [" ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 9, 20, 40]))) for _ in range(40)]
    items += [f"{items[-1]} and then some more words follow here {k}" for k in range(8)] + ["a a a a a a a a a", items[3], "How many?", "", None, "..."]
    texts = []
    for _ in range(150):
        t = r.choice(items) or ""
        t = r.choice([t, t.lower(), t.upper(), t.replace("Anna", "Carla Maria").replace("12", "15"), " ".join(t.split()[: r.randint(1, 40)]), " ".join(w for w in t.split() if r.random() < 0.95)])
        texts.append(" ".join(r.choice(words) for _ in range(r.randint(0, 10))) + ". " + t + " " + " ".join(r.choice(words) for _ in range(r.randint(0, 10))))
    texts += [texts[5]] * 30 + ["a " * 5000, None, ""]
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(2**53 + 1, texts[8])], "doc_id long, text string")
    bench = spark.createDataFrame([(k if k % 11 else None, t) for k, t in enumerate(items)], "item_id long, text string")
    probe = decontamination.Probe([(x.item_id, x.text) for x in bench.collect() if x.item_id is not None])
    expected = Counter((d.doc_id, *m) for d in docs.collect() for m in probe.matched(d.text))
    got = Counter(tuple(x) for x in decontamination.contaminated(docs, bench).collect())
    assert len(expected) > 100 and got == expected and any(k[0] == 2**53 + 1 for k in got)
    kept = Counter(map(tuple, decontamination.drop_contaminated(docs, bench).collect()))
    assert kept == Counter(tuple(d) for d in docs.collect() if not probe.matched(d.text))
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0 and decontamination.drop_contaminated(docs, bench.limit(0)).count() == docs.count()
    assert decontamination.contaminated(rough, bench.selectExpr("*", "1 AS th", "2 AS item", "3 AS h")).count() >= 0


def test_short_items_are_found_word_for_word():
    probe = decontamination.Probe([(1, "Why is Rome old?"), (2, "Yes")])
    assert [(m[0], m[-1]) for m in probe.matched("So, why is ROME old")] == [(1, True)] and [m[0] for m in probe.matched("yes!")] == [2]
    assert not probe.matched("Why is Paris old?") and not probe.matched("yesterday")


def test_inconsistent_slots_are_no_match():
    item = "Anna gave 3 books to Boris and Anna got 3 pens from Boris while Anna had 3 cups"
    other = "Clara gave 4 books to Dora and Emil got 9 pens from Fritz while Gerd had 8 cups"
    same = "Clara gave 4 books to Dora and Clara got 4 pens from Dora while Clara had 4 cups"
    probe = decontamination.Probe([(1, item)])
    assert not probe.matched(other) and [m[0] for m in probe.matched(same)] == [1] and not probe.matched(None)


CASED = "When Anna Berg walks from Berlin to Potsdam, which takes 6 hours, how many miles does Anna Berg walk if Straße 9 is closed?"


@pytest.mark.parametrize("change", [str.lower, str.upper, str.title, lambda t: t.lower().replace("6", "8")])
def test_copies_in_other_letter_case(change):
    probe = decontamination.Probe([(1, CASED)])
    got = probe.matched(f"Before it. {change(CASED)} After it.")
    assert [m[0] for m in got] == [1] and got[0][-1] == ("8" not in change(CASED))
    assert not probe.matched("when some people walk from town to town, how many hours does it take if the road is closed?")


@pytest.mark.parametrize("value,other", [("Paris", "New York City"), ("25", "twenty five"), ("Anna", "Anna Maria")])
def test_values_of_another_number_of_words(value, other):
    item = "Anna asks how long a train needs from Paris if 25 people wait outside"
    probe = decontamination.Probe([(1, item)])
    for text in (item.replace(value, other), f"Well. {item.replace(value, other)}. So"):
        assert [(m[0], m[-1]) for m in probe.matched(text)] == [(1, False)]
    assert [(m[0], m[-1]) for m in decontamination.Probe([(1, item.replace(value, other))]).matched(item)] == [(1, False)]
    assert [m[-1] for m in probe.matched(f"Well. {item}")] == [True] and not probe.matched("Anna asks how long a train needs from Paris")


def test_joined_values_must_agree():
    item = "Paris gave three books to Boris and then Paris got some pens from Boris while Paris slept"
    probe = decontamination.Probe([(1, item)])
    assert [m[0] for m in probe.matched(item.replace("Paris", "New York"))] == [1]
    assert not probe.matched("New York gave three books to Los Angeles and then Rio Verde got some pens from Fritz while San Jose slept")


PAGES = [
    ("<body><div id='header'><a href=x>Site</a></div><nav>A B</nav><article><h1>T&amp;t</h1><p>One <b>two</b>three.<p>Four&nbsp;&#233;</article><footer>f</footer></body>", "T&t One twothree. Four é"),
    ("<body><div class=menu><a href=x>A</a> <a>B</a></div><div id=content><h1>Title</h1><div class='text'><p>A long paragraph of text, with words.</p><p>Second one here, with more words in it.</p></div><div class=comments><p>nice post</p></div></div><div class=sidebar>side</div></body>", "Title A long paragraph of text, with words. Second one here, with more words in it."),
    ("<html><body><h1>T</h1><p>one two three</p><p>four five</p><form>x<input></form><script>var a = '<p>';</script></body></html>", "T one two three four five"),
    ("<article><header><h1>H</h1></header><p>x\n y</p><section class='comments'><p>c</p></section></article>", "H x y"),
    ("<article><h1>Cut</h1><p>off in the mid", "Cut off in the mid"),
    ("<article><p>cut in a tag</p><div cla", "cut in a tag"),
    (None, ""), ("", ""), ("<p>", ""),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text(html, text):
    assert markup.main_text(html) == text


@pytest.mark.parametrize("name", ["share", "related", "header", "rail", "discussion", "search widget"])
def test_names_that_hint_count_on_links_and_controls_only(name):
    page = "<body><div class=content><h1>T</h1><p>A paragraph of text with words in it.</p><div class='{}'>{}</div></div><div class=sidebar>side</div></body>"
    own = "T A paragraph of text with words in it."
    assert markup.main_text(page.format(name, "<p>Second paragraph, which belongs to the text.</p>")) == f"{own} Second paragraph, which belongs to the text."
    assert markup.main_text(page.format(name, "<a href=x>one</a> <a href=y>two</a>")) == own == markup.main_text(page.format(name, "find it: <input>"))


HOSTILE = ["<div>", "<b>", "<table><td>x", "<a ", "<!-- ", "<!-- >x", "<![CDATA[ >", '<a href="', "<p><b>", "&a", "<", "</p>"]


@pytest.mark.parametrize("part", HOSTILE)
def test_hostile_markup_takes_linear_time(part):
    import time

    times = []
    for n in (10_000, 40_000):
        began = time.process_time()
        markup.main_text("<article><p>text" + part * n)
        times.append(time.process_time() - began)
    assert times[1] < 10 * times[0] + 0.5


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("no markup at all", "no markup at all"), ("plain &amp; text", "plain & text"), ("a<br>b &amp; c", "a b & c"), ("<!-- c -->bare", "bare"), ("x<p>y</p>z", "x y z"),
        ("<body>bare<p>one</p></body>", "bare one"), ("<p>foo<b>bar</b>baz <i>qux</i></p><p>n<br>m</p><ul><li>a</li><li>b</li></ul>", "foobarbaz qux n m a b"),
        ("<main><div class='promo-free'><p>one two three</p></div></main>", "one two three"), ("<article><div class='comment-free analysis'><p>one two</p></div></article>", "one two"),
        ("<section id='no-comment'>alpha beta</section>", "alpha beta"), ("<div class='cookie-recipe'>mix the flour</div>", "mix the flour"),
        ("<article><p>one two three four</p><div class='comment-list'>a reader says</div></article>", "one two three four"), ("<body><div id='adTop'>buy now</div><p>one two three four five</p></body>", "one two three four five"),
        ("<article><p>one two three</p><div class='cookie-recipe'><a href='#'>a</a><input></div></article>", "one two three"),
    ],
)
def test_pieces_and_marked_names(html, text):
    assert markup.main_text(html) == text


def test_rough_pages(spark):
    rows = [(2**53 + 1, "u", "<p>x</p>"), (None, None, "<p>y</p>"), (1, None, None), (1, None, None), (2, "u", ""), (3, "u", "no markup at all"), (4, "u", "<div>" * 5000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in markup.extract(pages).collect())
    assert got == Counter((k, u, t, len(t)) for (k, u, _), t in zip(rows, ["x", "y", "", "", "", "no markup at all", "deep"]))


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r for r in markup.extract(pages.selectExpr("*", "1 AS text", "2 AS n_chars")).collect()}
    for r in pages.collect():
        inner = re.sub(r"<[A-Za-z/!][^<>]*\Z", "", re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1])
        text = " ".join(markup.re.sub("<[^>]+>", "", re.sub("</?(h1|p|br)[^>]*>", " ", inner)).split())
        import html

        assert found[r.page_id].text == " ".join(html.unescape(text).split()) and found[r.page_id].n_chars == len(found[r.page_id].text)
    assert markup.extract(pages.limit(0)).count() == 0
    assert len(markup.main_text("<div>" * 5000 + "deep text" + "</div>" * 5000)) == 9


def test_quote_levels():
    own, quotes = chat.parse("On Monday, X wrote:\n> > older line\n> newer line\n>> older again\n\nmy answer\n> tail")
    assert own == "my answer" and quotes == [(2, "older line"), (1, "newer line"), (2, "older again"), (1, "tail")]
    assert chat.parse(None) == ("", []) and chat.parse("") == ("", [])


CHAT = [
    (1, 0, "user", "Hello there my friend.\nHow is the weather today?"), (1, 1, "assistant", "It is sunny in the south."),
    (1, 2, "user", "On Monday, X wrote:\n> How is the  WEATHER today?\n\nI asked about the north really."), (1, 3, "assistant", "> > How is the weather today?\n> I asked about the north really.\nNorth is cold."),
    (2, 5, "user", "> How is the weather today?\nquoted from elsewhere"), (2, 6, None, ""), (None, None, "user", None),
]


def test_conversations(spark):
    df = spark.createDataFrame(CHAT + [CHAT[1]], "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS h", "2 AS key", "3 AS root")
    got = sorted(((r.conv_id, r.turn, r.text, r.parent_turn, r.root_turn, r.position, r.linked) for r in chat.conversations(df).collect()), key=str)
    assert got == sorted([
        (1, 0, CHAT[0][3], None, 0, 0, 0), (1, 2, "I asked about the north really.", 0, 0, 1, 1), (1, 3, "North is cold.", 2, 0, 2, 2),
        (1, 1, CHAT[1][3], 0, 1, 3, 0), (1, 1, CHAT[1][3], 0, 1, 3, 0), (2, 5, "quoted from elsewhere", None, 5, 0, 0), (2, 6, "", 5, 6, 1, 0), (None, None, "", None, None, 0, 0),
    ], key=str)
    assert chat.conversations(df.limit(0)).count() == 0


def test_conversations_brute(spark):
    """Random threads: every quote names its original, and replies come after what they reply to."""
    r, rows, parents = random.Random(5), [], {}
    for conv in range(6):
        said: list[str] = []
        for turn in range(25):
            own = f"message {conv} {turn} " + " ".join(r.choice("alpha beta gamma delta".split()) for _ in range(4))
            to = r.randrange(turn) if turn and r.random() < 0.6 else None
            rows.append((conv, turn, "user", (f"> {said[to]}\n" if to is not None else "") + own))
            parents[conv, turn] = to if to is not None else turn - 1 if turn else None
            said.append(own)
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(x.conv_id, x.turn): x.parent_turn for x in got} == parents
    place = {(x.conv_id, x.turn): x.position for x in got}
    assert all(p is None or place[c, p] < place[c, t] for (c, t), p in parents.items()) and all(">" not in x.text for x in got)


def test_conversations_of_any_size(spark):
    """One conversation with most messages, a passage that they all share, null keys and turns: the order holds across ranges."""
    rows = [(1, n, "user", ("> Yes.\n" if n % 2 else "") + "Yes.\n" + f"own {n}") for n in range(400)] + [(k, n, "user", f"> own {n - 1}\nown {n}") for k in (2, None) for n in range(3)] + [(None, None, "user", "own 9")] * 2
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    hot = {x.turn: x for x in got if x.conv_id == 1}
    assert all(hot[n].parent_turn == n - 1 and hot[n].linked == n % 2 for n in range(1, 400)) and hot[0].parent_turn is None
    assert sorted(x.position for x in hot.values()) == list(range(400)) and all(hot[n].position > hot[n - 1].position for n in range(1, 400) if n % 2)
    other = {x.turn: (x.parent_turn, x.linked) for x in got if x.conv_id is None}
    assert other == {None: (None, 0), 0: (None, 0), 1: (0, 1), 2: (1, 1)}


def test_registered_query_links_quotes(spark):
    """The query's mails, by a plain reading of the table: who is quoted, where chains begin, and in which order messages stand."""
    from reviewlake.llm.queries import QUERIES

    table = spark.read.parquet(f"{SF}/conversations.parquet")
    quoted = {(r.conv_id, r.turn): r.q for r in table.withColumn("q", chat.quoted_turn("conv_id", "turn")).collect()}
    texts = {(r.conv_id, r.turn): r.text for r in table.collect()}
    got = QUERIES["op3_chat_formatting"](spark, SF).collect()
    assert len(got) == len(texts)

    def root(c, t):
        while quoted[c, t] is not None:
            t = quoted[c, t]
        return t

    for x in got:
        key, q = (x.conv_id, x.turn), quoted[x.conv_id, x.turn]
        before = max((t for c, t in texts if c == x.conv_id and t < x.turn), default=None)
        assert x.parent_turn == (before if q is None else q) and x.root_turn == root(*key) and (x.linked > 0) == (q is not None)
        assert x.chat == f"<|{x.role}|>\n{texts[key].strip(chr(10))}\n"
    for c in {x.conv_id for x in got}:
        order = [(x.root_turn, x.turn) for x in sorted((x for x in got if x.conv_id == c), key=lambda x: x.position)]
        assert order == sorted(order)
    assert sum(x.linked > 0 for x in got) > len(got) / 3


def test_short_quotes_and_sentences(spark):
    said = ["Yes.", "Thanks!", "好的。", "👍", "It rains in the north. Bring a coat! The south is dry.", "今天下雨。明天晴天。", "One sentence that goes\nover two lines. And more.", "a b"]
    quoted = [*said[:4], "Bring a coat!", "明天晴天。", "One sentence that goes\nover two lines.", "A B"]
    rows = [(1, n, "user", t) for n, t in enumerate(said)]
    rows += [(1, 10 + n, "user", "".join(f"> {x}\n" for x in q.split("\n")) + f"reply {n}") for n, q in enumerate(quoted)]
    # A short part of a longer quote does not outweigh the whole of it.
    rows += [(2, 0, "user", "I went there by train.\nYes."), (2, 1, "user", "Yes."), (2, 2, "user", "> I went there by train.\n> Yes.\nreply"), (2, 3, "user", "> went there\npart of a sentence")]
    got = {(x.conv_id, x.turn): (x.parent_turn, x.linked) for x in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, 10 + n][0] for n in range(len(quoted))] == list(range(len(quoted)))
    assert got[2, 2][0] == 0 and got[2, 3] == (2, 0)
