"""The kernels of the training-data operators against plain reference computations."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from lectern.llm import ann_forest, html_extract, lang_id, packing, piece_bpe, pu_quality, repetition, simhash, toxicity


def chars(rnd, n, alphabet):
    return "".join(rnd.choice(alphabet) for _ in range(n))


# --- repetition


def slow_reach(words):
    n = len(words)
    out = [0] * n
    for i, j in itertools.permutations(range(n), 2):
        k = 0
        while i + k < n and j + k < n and words[i + k] == words[j + k]:
            k += 1
        out[i] = max(out[i], k)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_repetition_numbers(seed):
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 50))) + rnd.choice(["", "\n#é\na\na", "\xa0 b"]) for _ in range(8)] + [None, ""]
    for text, row in zip(texts, repetition.measure(texts, 10).tolist(), strict=True):
        t = text or ""
        words = t.replace("\n", " ").split(" ")
        words = [w for w in words if w]
        reach = slow_reach(words)
        cover = lambda f: len(set().union(*[range(i, i + f(m)) for i, m in enumerate(reach)])) if words else 0
        lines = [x for x in t.split("\n") if x.strip(" ")]
        assert row == [len(words), sum(map(len, words)), t.count("#"), len(lines) - len(set(lines)), cover(lambda m: 5 if m >= 5 else 0), cover(lambda m: m if m >= 10 else 0), max(reach, default=0)]


def test_one_word_a_thousand_times():
    row = repetition.measure(["w " * 3000], 10)[0].tolist()
    assert row[0] == 3000 and row[4] == 3000 and row[6] == 2999


# --- simhash


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("seed", range(5))
def test_fingerprints(seed):
    rnd = random.Random(seed)
    texts = [" ".join(chars(rnd, 3, "aBÉ") for _ in range(rnd.randint(0, 30))) + rnd.choice(["", "\n x\ty"]) for _ in range(20)] + ["", None, " \n"]
    assert [int(x) & (1 << 64) - 1 for x in simhash.fingerprints_of(texts, 4)] == [slow_fingerprint(t) for t in texts]


def test_covering_family():
    for size in (3, 4):
        family = simhash.covering(8, 4, size)
        assert all(any(not set(c) & set(d) for c in family) for d in itertools.combinations(range(8), 4))
    assert len(simhash.covering(8, 4, 3)) == 20


def components(edges, nodes):
    root = {n: n for n in nodes}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_bucket_links_have_the_components_of_all_pairs():
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(4)]
    near = sorted({b ^ sum(1 << k for k in rnd.sample(range(12), rnd.randint(0, 5))) for b in base for _ in range(60)})
    found = np.array(near, np.uint64).view(np.int64)
    pairs = [(int(a), int(b)) for a, b in itertools.combinations(found, 2) if (int(a) ^ int(b)).bit_count() <= 4 or ((int(a) ^ int(b)) & (1 << 64) - 1).bit_count() <= 4]
    links = simhash.bucket_links(found, 4)
    nodes = [int(x) for x in found]
    assert components(links, nodes) == components(pairs, nodes) and len(links) < len(nodes)


# --- pieces


@pytest.fixture(scope="module")
def pieces():
    return piece_bpe.PrefixTable(public_tokenizers.path("piece_bpe_32k.model"))


TEXTS = ["", "  hello  world\n x", "日本語 text ▁ a▁b ﬁ ½ ́x\x00y", "   ", "\n\n\n", "a\tb  \t c", "1234567 89", "Ω≈ç√ 😀😀 <0x0A> <s> </s> <unk>", "x" * 300, "aaaa aaaaa" * 30, "　  ", "▁▁▁ " + " " * 37 + "z"]


def test_pieces_like_the_library(pieces):
    rnd = random.Random(4)
    texts = TEXTS + [chars(rnd, rnd.randint(1, 60), "ab theing. \n▁é日$1#&*") for _ in range(300)]
    for t, (n, ids, decoded) in zip(texts, pieces.encode(texts), strict=True):
        want = pieces.library.encode(t) + [2]
        assert ids == " ".join(map(str, want)).encode() and n == len(want) and decoded.decode("utf-8", "replace") == pieces.library.decode(want)
    assert pieces.encode([]) == []


def test_pieces_with_little_room():
    table = piece_bpe.PrefixTable(public_tokenizers.path("piece_bpe_32k.model"), most_runs=4, most_pairs=4, longest=3)
    for _ in range(3):
        assert [x[1] for x in table.encode(TEXTS)] == [" ".join(map(str, table.library.encode(t) + [2])).encode() for t in TEXTS]
    assert len(table.runs) < 200


# --- packing


@pytest.fixture(scope="module")
def words():
    return packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"), 1)


def test_words_like_the_library(words):
    rnd = random.Random(3)
    texts = ["", None, "it's IT'S we'll x<|endoftext|>y", "日本語 İ ΣΑΣ ß x²\t\x1c z", "Å é ́x 12", "ÀÉ ÷ × ª º µ ¿", "x" * 300] + [chars(rnd, rnd.randint(0, 40), "aBé's\n .,$12|><|ßÿ\t\x1c×") for _ in range(500)]
    for t, got in zip(texts, words.encode(texts), strict=True):
        assert got.dtype == np.dtype("<u4") and got.tolist() == words.library.encode(t or "", add_special_tokens=False).ids + [1]
    assert words.encode([]) == [] and [x.tolist() for x in words.encode([None, ""])] == [[1], [1]] and words.encode(["日"])[0].tolist()[-1] == 1


def test_words_with_little_room():
    table = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"), 1, most_runs=3, longest=4)
    texts = ["the thing, élan", "a thinglike thing... ß", ""]
    for _ in range(3):
        assert [x.tolist() for x in table.encode(texts)] == [table.library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert len(table.runs) <= 9


def test_differencing_classic():
    sizes = [8, 7, 6, 5, 4]
    assert sorted(sum(sizes[i] for i in w) for w in packing.differencing(sizes, 2)) == [14, 16]


@pytest.mark.parametrize("seed", range(20))
def test_chunk_plan(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([1, rnd.randint(1, 300), rnd.randint(1, 9000)]) for _ in range(rnd.randint(1, 60))]
    rows = packing.plan_chunk(lengths, 2048, 512)
    for d, n in enumerate(lengths):
        mine = sorted((s, k) for i, s, k, _, _ in rows if i == d)
        assert [s for s, _ in mine] == list(itertools.accumulate([0] + [k for _, k in mine]))[:-1] and sum(k for _, k in mine) == n
    for q in {r[3] for r in rows}:
        mine = sorted((o, k) for _, _, k, s, o in rows if s == q)
        assert [o for o, _ in mine] == list(itertools.accumulate([0] + [k for _, k in mine]))[:-1] and sum(k for _, k in mine) <= 2048


def test_little_padding():
    rnd = random.Random(9)
    lengths = [rnd.randint(1, 1500) for _ in range(1500)]
    used = len({r[3] for r in packing.plan_chunk(lengths, 2048, 512)})
    assert sum(lengths) / (2048 * used) > 0.98


# --- language models


def test_kneser_ney_sums_to_one():
    text = "the cat sat on the mat and the dog sat too "
    s, counts, _ = lang_id.symbols([text * 3])
    keys, n = np.unique(lang_id.grams(s)[counts], return_counts=True)
    model = lang_id.OneLanguage.of(keys, n)
    kinds = len(model.grams[0])
    for context in (keys[5] >> np.uint64(16), keys[0] >> np.uint64(16)):
        every = (context << np.uint64(16)) | model.grams[0]
        assert abs(model.probability(4, every, kinds).sum() - 1) < 1e-9


def test_tables_give_the_models_probabilities():
    rnd = random.Random(1)
    texts = {"a": chars(rnd, 4000, "abcd e"), "b": chars(rnd, 4000, "defg h")}
    counts = {}
    for k, t in texts.items():
        s, c, _ = lang_id.symbols([t])
        counts[k] = np.unique(lang_id.grams(s)[c], return_counts=True)
    models = lang_id.LanguageModels(counts)
    s, c, _ = lang_id.symbols([chars(rnd, 500, "abcdefgh xyz")])
    keys = lang_id.grams(s)[c]
    for j, k in enumerate(models.langs):
        want = np.log(lang_id.OneLanguage.of(*counts[k]).probability(4, keys, models.kinds))
        assert np.allclose(models.log_probabilities(keys)[:, j], want, atol=1e-4)
    got = models.judge(["abcd abca", "hgfd edfg", "", None, "12 $"])
    assert [g[0] for g in got] == ["a", "b", "und", "und", "und"] and all(0 <= g[1] <= 1 for g in got)


def test_a_text_is_scored_alike_alone_and_in_company():
    counts = {"a": np.unique(lang_id.grams(lang_id.symbols(["hello there"])[0]), return_counts=True)}
    models = lang_id.LanguageModels(counts)
    together, _ = models.entropies(["hello", "there you", "", "hello"])
    alone, _ = models.entropies(["hello"])
    assert together[0] == alone[0] == together[3]


# --- classifiers


def test_features_of_empty_and_long():
    x = pu_quality.features(["", None, "a " * 20_000, "!!! $$$", "One line.\nOne line."])
    assert np.isfinite(x).all() and not x[0].any() and x[4][11] == 0.5


def test_class_prior_and_risk():
    rnd = np.random.default_rng(0)
    good, bad = rnd.normal(1, 0.5, (4000, len(pu_quality.FEATURES))), rnd.normal(-1, 0.5, (4000, len(pu_quality.FEATURES)))
    mixed = np.concatenate([good[2000:], bad[:1000]])
    model = pu_quality.fit_model(good[:2000].astype(np.float32), mixed.astype(np.float32))
    assert 0.5 < model.prior < 0.75
    assert (model.score(good[:2000]) > 0.5).mean() > 0.97 and (model.score(bad[2000:]) < 0.5).mean() > 0.97


def test_no_labels_still_scores():
    empty = np.zeros((0, len(pu_quality.FEATURES)), np.float32)
    assert pu_quality.fit_model(empty, empty).score(pu_quality.features(["x"])).tolist() == [0.5]
    w, b = toxicity.fit(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))
    assert len(w) == 0 and b == 0


def test_ngram_presence_counts_once():
    of, feature = toxicity.presence(["aaaa aaaa", "", None, "b"])
    assert len(set(zip(of.tolist(), feature.tolist(), strict=True))) == len(of) and 1 not in of


def test_symbols_keep_marks_and_whole_code_points():
    text = "हिन्दी में, नमस्ते"
    s, counts, _ = lang_id.symbols([text])
    assert "".join(map(chr, s[counts].tolist())).strip() == text.replace(",", "")
    s, counts, owner = lang_id.symbols(["\U00010400\U0001f600\U00010331x", "", "a"])  # Deseret in lower case, an emoji, Gothic
    assert s[counts & (owner == 0)].astype("<u2").tobytes().decode("utf-16-le") == "\U00010428 \U00010331x "
    s, counts, _ = lang_id.symbols(["a\ud800b"])
    assert "".join(map(chr, s[counts].tolist())) == "a b "


# --- pages

LOST = "a text of its own that is long enough to be taken for what the page is about " * 4
LOST = LOST.strip()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain", "plain"),
        ("<article><h1>T &amp; U</h1><p>a  b\nc<p>d<br>e</article><footer>x</footer>", "T & U\na b c\nd e"),
        ("<nav>m</nav><article><p>x</p><div class='share-bar'>s</div><section id=comments><p>c</p></section><p>y</p></article>", "x\ny"),
        ("<body class='has-sidebar'><main><div class=content><p>k &lt; l&nbsp;m</p></div><form><p>f</p></form></main></body>", "k < l m"),
        ("<article><p title='a>b'>t<script>var x='</p>';</script><style>p{}</style></p><!-- <p>no</p> -->z</article>", "t\nz"),
        ("<article><p><b>bold<br><p>next</b></p><ul><li>one<li>two</ul></article>", "bold\nnext\none\ntwo"),
        ("<article><header><h1>In</h1></header><p>x &am y &amp z</p><aside>no</aside></article>", "In\nx &am y & z"),
        # raw text holds anything up to its own end tag
        ("<script>if(a<b){x=1}</script><article>kept</article>", "kept"), ('<script>var s="<!--"</script><article>kept</article>', "kept"), ("<style>a:after{content:'<nav>'}</style><p>kept", "kept"),
        ("<script>document.write('<p>no</p>')</SCRIPT ><p>kept</p>", "kept"), ("<title>a<b</title><textarea><p>no</textarea><p>kept</p>", "kept"), ("<p>kept</p><script>open", "kept"),
        ("<html><head><title>t</title><meta charset=x><body><article>kept</article>", "kept"), ("<head><p>kept</p>", "kept"), ("<svg><svg><text>no</text></svg>no</svg>kept", "kept"),
        # attributes
        ("<article><p data-x='" + "y>" * 4000 + "'>Hello</p></article>", "Hello"), ("<article><p title='a hidden gem'>kept</p><p hidden>no</p></article>", "kept"), ("<p class=\"x'>kept</p><p>more</p>", "kept\nmore"),
        ("<p \"a>kept</p>", "kept"), ("<article><p title='class=ad' class=b>kept</p><p class='ad'>no</p></article>", "kept"),
        # which of several marks
        ("<main><p>Long text of it</p><article class='card'>card</article></main>", "Long text of it"), ("<article><p>The long article itself</p></article><article>teaser</article>", "The long article itself"),
        ("<article>The long article itself<article class=feedback>reply</article><article>and one more reply</article></article>", "The long article itself"),
        ("<article>T<article>The long article inside another one</article></article>", "The long article inside another one"), ("<article>one part</article><article>two parts</article>", "one part\ntwo parts"),
        ("<main><h1>t</h1><article>The long article itself</article></main>", "The long article itself"), ("<article></article><p>kept</p>", "kept"), ("<main></main><p>kept</p>", "kept"),
        # a whole page in one form, in places that are dropped, or behind what is never closed
        ("<form id=aspnetForm><input type=hidden><div class=nav>m</div><article>kept</article></form>", "kept"), (f"<form><input><p>{'long text ' * 60}</p></form>", ("long text " * 60).strip()), ("<p>k</p><form><label>Your name</label><input><p>Send</p></form>", "k"),
        (f"<svg><path d=x><article>{LOST}</article>", LOST), (f"<video src=x><article>{LOST}</article><video>no</video>", LOST), (f"<nav><a>m</a><article>{LOST}</article>", LOST), (f"<nav><a>m</a><p>{LOST}</p>", f"m\n{LOST}"),
        (f"<article class=sidebar>{LOST}</article>", LOST), (f"<p>x</p><div class=related><article>{LOST}</article><article>teaser</article></div>", LOST), (f"<p>{LOST} own</p><div class=comments><article>{LOST}</article></div>", f"{LOST} own"),
        ("<article>a<button>b<p>kept</p></article>", "a\nkept"), ("<article>a<button><div>no</div></button>b</article>", "ab"), ("<p>kept</p><label for=x>Name</label><input id=x><fieldset><legend>no</legend></fieldset>", "kept"),
        # labels in one word
        ("<article>kept<div class=userComments>no</div><ul class=commentlist><li>no</ul><ins class=adsbygoogle>no</ins><div id='cookieBanner'>no</div><p class='shareholder addresses'>yes</p></article>", "kept\nyes"),
        # tags left open, and end tags that reach too far
        ("<article><p class=ad>no<div>kept</div></article>", "kept"), ("<article><table><tr><td class=sidebar>no<td>kept</table></article>", "kept"), ("<span><article>a</span> b</article>", "a b"),
        ("<article><table><tr><td>a</div>b</td></tr></table>c</article>", "a\nb\nc"), ("a<!-->b<!--->c<!-- x --!>d</ x>e</>f<?x?>g<![CDATA[h]]>i", "abcdefgi"), ("super<wbr>long", "superlong"), ("x < y <3 <", "x < y <3 <"),
    ],
)
def test_article_of_one_page(html, text):
    assert html_extract.main_texts([html_extract.parse(html)]) == [text]


def test_repeated_runs_go_without_marks():
    menu = "<div>home about contact us press jobs legal imprint and more</div>"
    pages = [f"<body>{menu}<p>{' '.join(f'w{k}x{i}' for i in range(30))}</p>{menu}</body>" for k in range(3)]
    got = html_extract.main_texts([html_extract.parse(p) for p in pages])
    assert got == [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(3)]


def test_common_runs_go_inside_an_article():
    share = "<div>send this to all of your friends by mail or print</div>"
    passage = "a passage that some but not all pages of the site quote"
    pages = [f"<article><p>{' '.join(f'w{k}x{i}' for i in range(30))}</p>{share}<p>{passage if k < 5 else k}</p></article>" for k in range(10)]
    got = html_extract.main_texts([html_extract.parse(p) for p in pages])
    assert got == [" ".join(f"w{k}x{i}" for i in range(30)) + f"\n{passage if k < 5 else k}" for k in range(10)]
    same = [html_extract.parse(f"<article>{' '.join(map(str, range(40)))} {k}</article>") for k in range(10)]
    assert [len(t.split()) for t in html_extract.main_texts(same)] == [41] * 10


def test_copies_of_a_page_are_no_boilerplate():
    page = "<p>" + " ".join(f"w{i}" for i in range(40)) + "</p>"
    assert all(html_extract.main_texts([html_extract.parse(page)] * 3))


@pytest.mark.parametrize("seed", range(10))
def test_repeated_tokens_against_all_pairs(seed):
    rnd = random.Random(seed)
    streams = [np.array([rnd.randint(0, 2) for _ in range(rnd.randint(0, 40))], np.int64) for _ in range(5)]
    got = html_extract.repeated_tokens(streams, 4)[0]
    for a, (s, flags) in enumerate(zip(streams, got, strict=True)):
        want = np.zeros(len(s), bool)
        for b, t in enumerate(streams):
            if a != b and s.tobytes() != t.tobytes():
                grams = {tuple(t[i : i + 4]) for i in range(len(t) - 3)}
                for i in range(len(s) - 3):
                    if tuple(s[i : i + 4]) in grams:
                        want[i : i + 4] = True
        assert flags.tolist() == want.tolist()


# --- neighbours


def test_forest_finds_most_and_ties_by_id():
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(1500, 16)) * rnd.uniform(0.5, 2, (1500, 1))
    v[100:140] = v[100]
    ids = np.arange(1500)
    forest, hits, total = ann_forest.PrefixForest(v, 160), 0, 0
    for q, rows in zip(range(0, 1500, 20), forest.candidates(v[::20], 1200)):
        got, _ = ann_forest.best_of(v[rows], ids[rows], v[q], q, 20)
        want, score = ann_forest.best_of(v, ids, v[q], q, 20)
        hits, total = hits + len(set(got) & set(want)), total + len(want)
        assert (np.diff(score) <= 0).all()
        if q == 100:
            assert all(np.diff(want[score == score[0]]) > 0)
    assert hits / total > 0.9


@pytest.mark.parametrize("copies", [8, 12, 16, 19])
@pytest.mark.parametrize("spread", [0.0, 1e-3])
def test_copies_do_not_end_the_search(copies, spread):
    rnd = np.random.default_rng(copies)
    v = rnd.normal(size=(5000, 16))
    v[:copies] = v[0] + spread * rnd.normal(size=(copies, 16))
    (rows,) = ann_forest.PrefixForest(v, 160).candidates(v[:1], 1200)
    assert len(rows) > 1200 and len(ann_forest.best_of(v[rows], rows, v[0], 0, 20)[0]) == 20


def test_few_vectors_are_all_candidates():
    v = np.random.default_rng(5).normal(size=(15, 4))
    v[3:12] = v[3]
    for rows in ann_forest.PrefixForest(v, 160).candidates(v, 1200):
        assert rows.tolist() == list(range(15))


def test_crc_of_pieces():
    ids = np.arange(10, dtype="<u4")
    assert zlib.crc32(memoryview(ids.tobytes())[8:20]) == zlib.crc32(ids[2:5].tobytes())


def test_tables_of_other_operators_go_first():
    from lectern.llm import common

    common.worker_tables.update({("one", 1): "a", (__name__, 2): "b"})
    run = common.tidied(lambda batches: iter(batches))
    assert list(run([3])) == [3] and common.worker_tables == {(__name__, 2): "b"}
    common.worker_tables.clear()
