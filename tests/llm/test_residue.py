import pytest

from tessera.llm.residue import KINDS, Likeness, literals, residue, residue_segments, trigrams, without_residue

HELD = [
    "Dear {{ first_name }}, the folder {0} is ready.", "Scene: ${site}, recorded at the mill.", "Contact %FIRST_NAME% about the van.", "폴더 #{촬영일}의 설명", "담당자는 $PROJECT$입니다.", "Photo by <your name here>.", "Caption ([INSERT LABEL]): van",
    "Welcome to the album (scene to be added)!", "The van belongs to XXXX.", "[[album]] / __OWNER__", "{% label %} at noon", "Hello %(name)s!",
    "Folder None contains None images of None.", "Title: [object Object].", "사진 NaN장이 있습니다.", "Camera: none / Lens: none / Place: none",
    "Lorem ipsum dolor sit amet.", "Text goes here.", "TBD. TBD. TBD.", "asdf asdf qwer asdf", "Untitled note.", "여기에 설명을 입력하세요.", "TODO: write the scene note.",
    "Please enable JavaScript to view this album.", "이 갤러리를 보려면 자바스크립트를 켜 주세요.", "Bitte aktivieren Sie JavaScript, um die Bilder zu sehen.", "<noscript>Scripts must be allowed.</noscript>",
    "500 Internal Server Error", '{"error": {"code": 920, "message": "folder not found"}}', "Traceback (most recent call last):", "OSError: image store offline", "페이지를 찾을 수 없습니다.", "Página no encontrada.", "ACCESS DENIED.", "Your session has expired.",
]
CLEAN = [
    "The export template writes `{{region}}` where the caption belongs, and the viewer fills it.", "In help topic 75 the token ${caption} stands for the folder name and is replaced on save.", "The sign reads “PAGE NOT FOUND”, painted as a joke.",
    "A laptop shows the words “enable JavaScript”, readable in crop 3.", "The note explains that status 500 means the worker stopped.", "Room 404 of the boat shed holds the van.", "Price tag of $28 on the van, 50% of it covered.", 'Class map entry {"57": "vest"} was added.',
    "The set {78, 3} of class ids covers the crane.", "Reviewers use [unclear] when the van can't be read and null when nothing is visible.", "A TODO list is pinned to the counter.", "도움말: 저장할 때 {{batch}} 자리에 폴더 이름이 들어간다고 설명한다.", "Frames tagged ‘error’ show glare.",
    "Known gaps: few frames at dusk, almost none of the playground.", "From the mill you can see the pylon; someone placed it in the centre.", "He moved <b>two</b> vans & a crane.",
]


@pytest.mark.parametrize("text", HELD)
def test_found(text):
    assert list(residue_segments("A real sentence stands before. " + text + "\nAnd one after."))


@pytest.mark.parametrize("text", CLEAN)
def test_not_found(text):
    assert not list(residue_segments(text))


def test_table(spark):
    weak = "Sign in again to see the pictures."
    rows = [(1, "Fine text.", "/a"), (2, "Fine. Dear {{name}}, hello.", None), (3, None, "/a"), (4, "", "/a"), (5, "Long story about vans. " * 20 + weak, "/a"), (6, "Another story about cranes. " * 20 + weak, "/b"), (7, "Here the guide says much about piers. " * 20 + "Something went wrong with the crane.", "/c")]
    rows += [(8, "word " * 200_000 + "${x}", "/d"), (2, "Fine. Dear {{name}}, hello.", None), (None, "{{x}}", "/a")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, host string, kind string")
    got = {r["doc_id"]: r for r in residue(df).collect()}
    assert set(got) == {2, 5, 6, 8} and got[2]["kinds"] == ["placeholder"] and got[8]["share"] <= 1
    assert {r["doc_id"] for r in residue(df.filter("doc_id <> 6")).collect()} == {2, 8}  # at one host only
    assert {r["doc_id"] for r in without_residue(df).collect()} == {1, 3, 4, 7, None}
    assert residue(df.limit(0)).count() == 0
    assert residue(df, host_col=None).filter("doc_id = 2").count() == 1


WITHOUT_A_LISTED_WORD = [
    "400 Bad Request", "504 Server response", "time out while fetching the tile", "at app.render(app.js:12)", "cant open this page", "blah blah blah", "bbbb cccc", "[ insert name ]",
    "Page <b>not</b> found", "Page not&nbsp;found", "Page  not \u00a0found", "SERVİCE UNAVAİLABLE",
]


@pytest.mark.parametrize("text", WITHOUT_A_LISTED_WORD)
def test_no_word_is_needed_beyond_the_patterns(text):
    assert list(residue_segments("A real sentence stands before.\n" + text + "\nAnd one after."))


@pytest.mark.parametrize("text", ["Crop 12 45.", "Row 3, 4, 5", "10 20 30", "12 12 12"])
def test_numbers_repeat_without_being_filler(text):
    assert not list(residue_segments(text))


def test_literals_are_implied():
    """Whatever a pattern matches in the texts above has one of its needed strings."""
    for _, pattern in KINDS:
        words = literals(pattern)
        for text in HELD + CLEAN + WITHOUT_A_LISTED_WORD:
            if words and (m := pattern.search(text)):
                assert any(w in m[0].lower().replace("i\u0307", "i") for w in words), (text, m[0])


def test_tagged_is_no_explanation():
    assert list(residue_segments("Photo tagged {{tag}} by {{user}}"))


LATIN = ["Dasra mobissa avenexlo damnum selo bisfulmit.", "Rulmit onda temtem daspo loholra vecas.", "Avera darive tempetmit curmoful lora lenrada.", "Iudraebis numvane sedraetum bisfulpet fulsaqui."]
PROSE = "The surveyor moved the roof camera to the goods lift. Nobody touched the crate behind the storage yard. Frame seven is sharp again."


def test_filler_of_unknown_words_is_found_by_its_letters(spark):
    rows = [(n, f"Lorem ipsum {' '.join(reversed(LATIN[n % 4].lower().strip('.').split()))}. " + PROSE, "/a") for n in range(40)]
    rows += [(100, "Numvane mobissa lenrada onda temtem avera.\n" + PROSE, "/b"), (101, PROSE, "/c"), (102, "Numvane mobissa lenrada onda temtem avera.", "/x/onda")]
    got = {r["doc_id"]: r for r in residue(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert set(got) == set(range(40)) | {100, 102}
    assert got[100]["evidence"] == ["terms"] and got[100]["kinds"] == ["filler"] and got[5]["evidence"] == ["detector"]


def test_nothing_is_like_filler_where_none_is_known(spark):
    rows = [(1, LATIN[0] + " " + LATIN[1], "/a"), (2, PROSE, "/b")]
    assert residue(spark.createDataFrame(rows, "doc_id long, text string, source string")).count() == 0


def test_likeness_is_zero_without_filler():
    like = Likeness({g: (0, 7) for w in ("camera", "crate", "yard") for g in trigrams(w)})
    assert abs(like("camera crate yard camera crate")) < 1e-9 and like("camera crate") == float("-inf")


def test_long_names_and_quotes(spark):
    long = "a" + " very" * 60 + " long name"
    rows = [(1, "Dear {{" + long + "}}, hello.", "/a"), (2, "The sign says “page not found " + "and more " * 40 + "” in chalk.", "/a"), (3, "We kept it. aaaa bbbb cccc dddd And went on.", "/a")]
    assert {r["doc_id"] for r in residue(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()} == {1, 3}
