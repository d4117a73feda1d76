import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import answers, html, outline, selectors, text, timecode
from corpusmill.functions.filetypes import infer_filetype

L = F.lit


@pytest.mark.parametrize("reply, thinking, answer, ok", [
    ("plain", "", "plain", True),
    ("<think>why so</think><answer>b</answer>", "why so", "b", True),
    ("why so</think><answer>b</answer>", "why so", "b", True),
    ("<think>why so\n<answer>b</answer>", "why so", "\nb", True),
    ("<think>why so</think>b  ", "why so", "b", True),
    ("x <answer>b</answer> y", "", "x b y", True),
    ("<answer>b", "", None, False),
    ("b</answer>", "", None, False),
    ("<think>why<answer></answer>", "", None, False),
])
def test_think_answer(one, reply, thinking, answer, ok):
    got = one(answers.think_answer(L(reply)))
    assert (got["thinking"], got["ok"]) == (thinking, ok)
    if ok:
        assert got["answer"] == answer
    else:
        assert reply in got["answer"] and got["answer"].startswith("<note>")


@pytest.mark.parametrize("reply, score", [
    ("7", 7), ("-3", 3), (" \n", 5), ("<think>9</think><answer>2</answer>", 2), ("score\n8\nok", 8),
    ("about 6 maybe", 6), ("3 or 4", 5), ("none", 5), ("10/10", 5), ("100", 100),
])
def test_parse_score(one, reply, score):
    assert one(answers.parse_score(L(reply))) == score


@pytest.mark.parametrize("answer, keep", [
    ("IRRELEVANT", False), ("<answer>IRRELEVANT</answer> and a long explanation", False), ("ok", True),
    ("IRRELEVANT because of many reasons", True), ("IRRELEVANTLY", True),
])
def test_is_relevant(one, answer, keep):
    assert one(answers.is_relevant(L(answer))) is keep


def test_votes(one):
    votes = F.array(L(1), L(None).cast("int"), L(3))
    assert one(answers.mean_vote(votes)) == 3.0 and one(answers.keeps(votes))
    assert not one(answers.keeps(F.array(L(2), L(3))))


def test_source_replace_is_prefix_safe(one):
    got = one(text.source_replace(L("see X_21, X_2 and X_1"), F.array(L(1), L(2), L(21)), "X_"))
    assert got == "see [21](#document-21), [2](#document-2) and [1](#document-1)"


def test_citation_links(one):
    got = one(text.citation_links(L("a [p.42] b [p.7, file.pdf]"), "http://v/{source}#{page}", L("main.pdf")))
    assert got == "a [p.42](http://v/main.pdf#42) b [p.7](http://v/file.pdf#7)"


@pytest.mark.parametrize("question, parts", [
    ("a", ("a", "a")), ("a >>>> b", ("a", "b")), ("a>>>>b>>>>c", None),
])
def test_split_query(one, question, parts):
    got = one(text.split_query(L(question)))
    assert (tuple(got) if got else None) == parts


def test_repair_double_encoding(one):
    for word in ("déjà vu", "Größe", "日本", "plain", "naïve Ã"):
        assert one(text.repair_double_encoding(text.double_encode(L(word)))) == word
        assert one(text.repair_double_encoding(L(word))) == word


@pytest.mark.parametrize("url, local", [
    ("http://localhost:3000/x", True), ("http://127.0.0.1", True), ("http://[::1]:80/", True), ("https://nas.local", True),
    ("http://10.1.2.3", True), ("http://192.168.0.1", True), ("http://172.16.0.1", True), ("http://172.32.0.1", False),
    ("https://example.org/localhost", False), ("http://user@10.0.0.1/", True),
])
def test_is_local_host(one, url, local):
    assert one(text.is_local_host(L(url))) is local


def test_html(one):
    page = ('<html><head><style>p{}</style><script>var a="</p>";</script></head><body><!-- c --><ul><li>one</li><li>two &amp; three</li></ul>'
            '<p>four<br>five</p><img src="x.png"></body></html>')
    shown = one(html.html_to_text(L(page)))
    assert 'var a="</p>";' in shown and "p{}" in shown and '<img src="x.png">' in shown and "one\ntwo & three" in shown.replace(" \n", "\n").replace("\n ", "\n")
    assert "<img" not in one(html.html_to_text(L(page), remove_image=True))
    seen = one(html.visible_text(L(page)))
    assert "var a" not in seen and "p{}" not in seen and " c " not in seen and "two & three" in seen
    assert one(html.clean_if_html(L("a < b"))) == "a < b"
    assert one(html.page_title(L("<title> Hi &amp; ho </title>"))) == "Hi & ho"
    assert one(html.page_title(L("<p>none</p>"))) is None


def test_media_round_trip(one):
    card = 'x <img src="a.png"> y <img src="b.png"> [sound:a.mp3] http://x.org/y <img src="a.png">'
    state = html.take_media(L(card))
    got = one(state)
    assert got["content"].count("[IMAGE_1]") == 2 and "[IMAGE_2]" in got["content"] and "[SOUND_1]" in got["content"]
    assert len(got["media"]) == 4
    assert one(html.put_media_back(state)) == card


@pytest.mark.parametrize("line, bullet", [
    ("* a", "- a"), ("  * b", "  - b"), ("—c", "- c"), ("-d", "- d"), ("e", "- e"), ("\tf  ", "    - f"),
    ("- • g", "- g"), ("• h", "- h"), ("- **i", "- **i**"), ("- *j", "- *j*"), ("- a****b", "- ab"), ("- fine", "- fine"),
])
def test_bullets(one, line, bullet):
    assert one(outline.good_lines(L(line))) == [bullet]


def test_bullets_drop_lines_without_letters(one):
    assert one(outline.good_lines(L("12\n- a\n---\n\n  - b"))) == ["- a", "  - b"]


def test_intro_and_marks(one):
    lines = F.array(L("Let me take a deep breath"), L("- kept"), L("  deep breath inside"), L("I'll summarize it"))
    assert one(outline.strip_intro(lines)) == ["- kept", "  deep breath inside"]
    marked = "- Chunk 1/2\n- a\n- ---\n- Chunk 2/2\n- b \n- BEFORE RECURSION #1\n- old"
    assert one(outline.strip_recursion_marks(L(marked))) == "- a\n- b"


@pytest.mark.parametrize("raw, want", [
    ("caf&eacute; &#8217; &hearts; &#x1F600;", "café ’ ♥ 😀"), ("&amp;lt; &nope; &#0; &#xD800; &", "&lt; &nope; &#0; &#xD800; &"),
    ("a &lt; b &amp; c", "a < b & c")])
def test_entities(one, raw, want):
    assert one(html.html_to_text(L(raw))) == want


def test_windows_damage(one):
    assert one(text.repair_double_encoding(L("itâ€™s cafÃ©"))) == "it’s café"
    assert one(text.repair_double_encoding(L("it’s €5 café"))) == "it’s €5 café"


def test_outline_guard(one):
    assert one(outline.guard_outline_lines(L("- > quote\n> q\n1. first\nplain"))) == "- \\> quote\n\\> q\n- 1. first\nplain"


def test_broken_addresses(one):
    got = one(html.take_media(L("https ://a.org http:// b.org ftp:// c.org x :// y")))
    assert [m["media"] for m in got["media"]] == ["https://a.org", "http://b.org", "ftp://c.org"]


def test_citation_fallback(one):
    lines = F.array(L("- a"), L("  - b"), L("- c [p.3]"))
    assert one(outline.cite_fallback(lines, L(9), L(None).cast("string"))) == ["- a [p.9]", "  - b", "- c [p.3]"]
    assert one(outline.cite_fallback(lines, L(9), L("f.pdf")))[0] == "- a [p.9, f.pdf]"
    assert one(outline.cite_fallback(lines, L(None).cast("int"), L("f")))[0] == "- a"


def test_timecodes(one):
    assert one(timecode.seconds_to_timecode(L(3725.9))) == "01:02:05"
    assert one(timecode.timecode_to_seconds(L("01:02:05"))) == 3725
    assert one(timecode.timecode_to_seconds(L("x"))) is None


def test_compact_transcript(one):
    vtt = ("WEBVTT\n\n00:00:00.000 --> 00:00:05.000\nhello\n\n00:00:05.000 --> 00:00:09.000\nhello there\n\n"
           "00:00:16.000 --> 00:00:20.000\n<00:00:16.000><c>new</c> words\n\n00:00:20.000 --> 00:00:25.000\nwords\n\n00:00:40.000 --> 00:00:41.000\nend")
    assert one(timecode.compact_transcript(L(vtt))) == "00:16 new words\n00:40 end"
    assert one(timecode.compact_transcript(L(vtt), drop_hour=False)) == "00:00:16 new words\n00:00:40 end"


def test_caption_that_looks_like_its_code(one):
    vtt = "00:00:15.000 --> 00:00:17.000\n15\n\n00:00:17.000 --> 00:00:19.000\n00:00\n\n00:00:31.000 --> 00:00:33.000\n\n" \
          "00:00:47.000 --> 00:00:48.000\nlast\n00:00:50\nown code"
    assert one(timecode.compact_transcript(L(vtt), drop_hour=False)) == (
        "00:00:15 15\n00:00:31 last\n00:00:50 own code")
    assert one(timecode.compact_transcript(L(""))) == "" and one(timecode.compact_transcript(L(None).cast("string"))) is None


@pytest.mark.parametrize("asked, want", [
    ("library", ("library", [])), ("ALL", ("library", [])), ("tag:a, b", ("tag", ["a", "b"])), ("key:K1", ("items", ["K1"])),
    ("saved_search:My", ("search", ["My"])), ("col:A/B", ("collection", ["A/B"])), ("A/B", ("collection", ["A/B"])),
    ("odd:thing", ("collection", ["odd:thing"])),
])
def test_reference_selector(one, asked, want):
    assert tuple(one(selectors.reference_selector(L(asked)))) == want


@pytest.mark.parametrize("asked, want", [
    ("*", ("library", [])), ("favorites", ("favourites", [])), ("archived", ("archived", [])), ("tag:a,b", ("tag", ["a,b"])),
    ("ids:1, 2", ("ids", ["1", "2"])), ("search:is:fav", ("search", ["is:fav"])), ("list:L", ("list", ["L"])), ("L", ("list", ["L"])),
])
def test_bookmark_selector(one, asked, want):
    assert tuple(one(selectors.bookmark_selector(L(asked)))) == want


def test_collection_path(one):
    assert one(selectors.collection_path(L("A%% B /C"))) == ["A", "B", "C"]


@pytest.mark.parametrize("path, kind", [
    ("https://youtube.com/x/playlist?a", "youtube_playlist"), ("https://youtu.be/x", "youtube"), ("/l/logseq/a.md", "logseq_markdown"),
    ("/a.md", "txt"), ("http://x.org/a.pdf", "online_pdf"), ("/a.pdf", "pdf"), ("http://x.org", "url"), ("/a.htm", "local_html"),
    ("/a.ogg", "local_audio"), ("/a.epub", "epub"), ("/a.odp", "powerpoint"), ("/a.odt", "word"), ("/a.avi.x", "local_video"),
    ("/a.json.x", "json_entries"), ("/a.toml", "toml_entries"), ("/a", None),
])
def test_infer_filetype(one, path, kind):
    assert one(infer_filetype(L(path))) == kind


def test_parse_scalar(one):
    got = [tuple(one(text.parse_scalar(L(v)))) for v in ("True", "007", "none", "", "abc")]
    assert got == [("bool", "true"), ("int", "7"), ("none", None), ("none", None), ("str", "abc")]


def test_markdown(one):
    assert one(text.markdown_images_to_name(L("![short](u) ![a very long alternative text][r]"))) == "short a very l…ive text"
    assert one(text.markdown_links_to_text(L("[a](http://b) [c](ftp://d)"))) == "a [c](ftp://d)"
    assert one(text.strip_cloze(L("x {{c12::y}} z"))) == "x  y  z"


def test_hash_matches_sha256(one):
    import hashlib

    assert one(text.content_hash(L("é"))) == hashlib.sha256("é".encode()).hexdigest()[:20]
    assert re.fullmatch("[0-9a-f]{20}", one(text.content_hash(L(""))))
