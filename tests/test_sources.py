import io
import zipfile

import pytest

from siftloom.sources import extract as ex
from siftloom.sources import formats


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x"), data)
    return out.getvalue()


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_html_and_xml():
    assert ex.html_text("<p>A &amp; b</p><script>x</script><style>y</style> <b> c </b>") == "A & b\nc"


def test_cues():
    srt = "1\n01:01:05,000 --> 01:01:06,000\nHi\nthere\n\n2\n00:00:07,000 --> 00:00:08,000\nYou"
    assert ex.cues_text(srt.encode()) == "[t=61:05]\nHi there\nYou"
    with pytest.raises(ValueError):
        ex.cues_text(b"nothing")


def test_mail():
    mail = b"From: a@b.c\nTo: d@e.f\nSubject: S\nMIME-Version: 1.0\nContent-Type: text/plain\n\nBody here\n"
    assert ex.mail_text(mail) == "From: a@b.c\nTo: d@e.f\nSubject: S\n\nBody here"


def test_office():
    w = 'xmlns:w="w"'
    numbering = f'<w:numbering {w}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2)"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
    para = lambda t, level=None: f"<w:p>{'' if level is None else f'<w:pPr><w:numPr><w:ilvl w:val=\"{level}\"/><w:numId w:val=\"1\"/></w:numPr></w:pPr>'}<w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{para('a|b')}</w:tc><w:tc>{para('c')}</w:tc></w:tr><w:tr><w:tc>{para('1')}</w:tc><w:tc>{para('2')}</w:tc></w:tr></w:tbl>"
    doc = f"<w:document {w}><w:body>{para('Title')}{para('one', 0)}{para('sub', 1)}{para('sub', 1)}{para('two', 0)}{para('sub', 1)}{table}</w:body></w:document>"
    text = ex.docx_text(archive({"word/document.xml": doc, "word/numbering.xml": numbering}))
    assert text == "Title\n\n1. one\n\n1.a) sub\n\n1.b) sub\n\n2. two\n\n2.a) sub\n\n| a\\|b | c |\n| --- | --- |\n| 1 | 2 |"

    rows = "".join(f'<row><c r="A{i}" t="s"><v>{i % 2}</v></c><c r="C{i}"><v>{i}</v></c></row>' for i in range(1, 53))
    book = archive({
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="x1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="x1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>zero</t></si><si><t>one</t></si></sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>",
    })
    lines = ex.xlsx_text(book).split("\n")
    assert lines[:2] == ["## Sheet: S", "one |  | 1"] and lines[51:53] == ["## Sheet: S (continued)", "one |  | 1"] and lines[-1] == "zero |  | 52"

    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:t>Hello</a:t></a:p></p:sp><p:sp><a:p><a:t>Point</a:t></a:p></p:sp></p:sld>'
    assert ex.pptx_text(archive({"ppt/slides/slide1.xml": slide})) == "## Slide 1: Hello\nPoint"
    odt = '<o:doc xmlns:o="o" xmlns:t="t"><o:body><t:h>H</t:h><t:p>a<t:s t:c="2"/>b<t:tab/>c</t:p><t:tracked-changes><t:p>no</t:p></t:tracked-changes><t:p/></o:body></o:doc>'
    assert ex.odt_text(archive({"content.xml": odt})) == "H\na  b\tc"


def test_epub():
    book = archive({
        "META-INF/container.xml": '<c><rootfile full-path="O/p.opf"/></c>',
        "O/p.opf": '<package><manifest><item id="n" href="n.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="n"/><itemref idref="a"/><itemref idref="b"/></spine></package>',
        "O/n.xhtml": "<p>nav</p>", "O/a.xhtml": "<head><title>First</title></head><body><p>x</p></body>", "O/b.xhtml": "<p>y</p>",
    })
    assert ex.epub_text(book) == "## First\n\nx\n\n## Chapter 3\n\ny"


def test_numerals():
    assert [ex.roman(n) for n in (1, 4, 9, 40, 1994)] == ["i", "iv", "ix", "xl", "mcmxciv"]
    assert [ex.letters(n) for n in (1, 26, 27, 703)] == ["a", "z", "aa", "aaa"]


def test_types():
    assert formats.resolve("application/octet-stream", "a.csv").key == "csv" and formats.resolve("text/html; charset=x", None).key == "html"
    assert not formats.matches(b"%PDF-1.4", formats.resolve("text/html", "a")) and formats.matches(b"PK\x03\x04", formats.resolve(None, "a.docx"))
    assert ex.extract(b"{bad", "application/json", "a.json")[2] and ex.extract(b'{"a": 1}', "application/json", "a.json")[1] == '{\n  "a": 1\n}'
    assert ex.extract(b"\x89PNG\r\n\x1a\n", "image/png", "p.png")[1] == "[image: p.png, no text extracted]"
    assert ex.extract(b"a\x00b", "text/plain", "a.txt")[1] == "ab" and ex.extract(b"  ", "text/plain", "a.txt")[2] == "no text"
    assert ex.rtf_text(b"{\\rtf1{\\fonttbl{\\f0 X;}}Hi \\b bold\\b0\\par caf\\'e9}") == "Hi bold\ncaf\xe9"


def test_signatures():
    kind = lambda name: formats.resolve(None, name)
    assert formats.matches(b"junk\n%PDF-1.7", kind("a.pdf")) and not formats.matches(b"junk\n{\\rtf1", kind("a.rtf"))
    assert not formats.matches(b"\x89PNG\r\n\x1a\n", kind("a.txt")) and not formats.matches(b"%PDF-1 {\\rtf", kind("a.rtf"))
    assert formats.matches(b"PK\x03\x04", kind("a.xlsx")) and formats.matches(b"plain", kind("a.txt"))


def test_charsets():
    german = "Der Käufer übergibt die Güter an den Verkäufer. " * 20
    assert ex.decode(german.encode("latin-1")) == german
    assert ex.decode("x é".encode("utf-16")) == "x é" and ex.decode("\ufeffé".encode()) == "é"
    assert "Привет" in ex.decode(("Привет, как дела? Это обычный русский текст. " * 10).encode("cp1251"))


def test_rtf_numbers():
    assert ex.rtf_text(b"{\\rtf1 it\\u8217?s}") == "it\u2019s"
    assert ex.rtf_text(b"{\\rtf1\\uc2 a\\u233\\'c3\\'a9b{\\uc0\\u8364}c\\u8364xyz}") == "a\u00e9b\u20acc\u20acz"
    assert ex.rtf_text(b"{\\rtf1 \\u-10179?\\u-8704?!}") == "\U0001f600!"
    assert "\ud83d" not in ex.rtf_text(b"{\\rtf1 \\u-10179?}")


def test_list_labels():
    one, legal = ex.Level("upperRoman", "%1."), ex.Level("decimal", "%1.%2", 1, True)
    lists = {"1": ex.Numbers("b", {0: one, 1: ex.Level("lowerLetter", "%1.%2)"), 2: ex.Level("bullet")}, {}), "2": ex.Numbers("b", {0: one, 1: legal}, {0: 5}), "3": ex.Numbers("c", {}, {})}
    items = [("1", 0), ("1", 1), ("1", 1), ("1", 2), ("1", 0), ("1", 1), ("2", 0), ("2", 1), ("2", 0), ("1", 0), ("3", 1), ("3", 1)]
    assert list(ex.list_labels(items, lists)) == ["I.", "I.a)", "I.b)", "-", "II.", "II.a)", "V.", "5.1", "VI.", "VII.", "1.", "2."]


def test_no_file_kills_the_others(spark):
    """Damage of every kind is a row with an error, and what is no character does not stop a batch."""
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<document><body><p><t>fine</t></p></body></document>")
    good = packed.getvalue()
    broken = bytearray(good)
    at = broken.index(b"PK\x03\x04") + 30 + len("word/document.xml")
    broken[at : at + 8] = b"\xff" * 8
    files = [
        ("ok.docx", bytes(good)), ("broken.docx", bytes(broken)), ("cut.docx", bytes(good[:60])), ("deep.json", b"[" * 200_000), ("odd.json", b'"\\ud83d"'), ("odd.rtf", b"{\\rtf1 x\\u-10179?}"),
        ("odd.eml", b"Subject: s\r\nContent-Type: text/plain; charset=no-such\r\n\r\nbody \xe9"), ("empty.txt", b""), ("none.txt", None), ("what.zzz", b"x"), ("bad.xml", b"<a>&#xFFFFFFFFF;</a>"),
    ]
    rows = {r.name: r for r in ex.extract_files(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert len(rows) == len(files) and rows["ok.docx"].text == "fine"
    for name in ("broken.docx", "cut.docx", "deep.json", "empty.txt", "none.txt", "what.zzz"):
        assert rows[name].error and rows[name].text is None, name
    assert rows["odd.rtf"].text.startswith("x") and "body" in rows["odd.eml"].text and rows["odd.json"].error is None


def test_workbook_dates_and_columns():
    def book(cells, date1904=""):
        return archive({
            "xl/workbook.xml": f'<workbook xmlns:r="r">{date1904}<sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<x><Relationship Id="r1" Target="worksheets/sheet1.xml"/></x>',
            "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00&quot; days&quot;;[Red]0"/><numFmt numFmtId="166" formatCode="[$-409]h:mm"/></numFmts>'
            '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/></cellXfs></styleSheet>',
            "xl/worksheets/sheet1.xml": f"<worksheet><sheetData><row>{cells}</row></sheetData></worksheet>",
        })

    cells = '<c r="A1" s="1"><v>45292</v></c><c r="B1" s="2"><v>45292.5</v></c><c r="C1" s="3"><v>45292</v></c><c r="D1" s="4"><v>0.25</v></c><c r="E1"><v>45292</v></c><c r="F1" s="1" t="str"><v>no date</v></c><c r="G1" s="1"><v>1e99</v></c>'
    assert ex.xlsx_text(book(cells)).split("\n")[1] == "2024-01-01 | 2024-01-01T12:00:00 | 45292 | 06:00:00 | 45292 | no date | 1e99"
    assert ex.xlsx_text(book('<c r="A1" s="1"><v>43830</v></c>', '<workbookPr date1904="1"/>')).endswith("2024-01-01")
    assert ex.xlsx_text(book('<c r="XFD1"><v>1</v></c>')).endswith("| 1")
    for ref in ("XFE1", "ZZZZ1", "ZZZZZZZZZZZZ1"):
        with pytest.raises(ValueError, match="no column"):
            ex.xlsx_text(book(f'<c r="{ref}"><v>1</v></c>'))


def test_workbook_caps():
    def book(cell, refs="", n=700):
        return archive({
            "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<x><Relationship Id="r1" Target="worksheets/sheet1.xml"/></x>',
            "xl/worksheets/sheet1.xml": f'<worksheet><sheetData>{"".join(f"""<row><c r="A{i}" t="inlineStr"><is><t>{cell}</t></is></c></row>""" for i in range(1, n))}</sheetData>{refs}</worksheet>',
        })

    with pytest.raises(ValueError, match="characters"):
        ex.xlsx_text(book("y" * 9000))
    text = ex.xlsx_text(book("v", '<mergeCells><mergeCell ref="A2:C2"/></mergeCells>'))
    assert "v [merged A2:C2]" in text and text.count("merged") == 1
    assert ex.xlsx_text(book("z" * 20_000, n=2)).endswith("z...[truncated, 20000 chars]")


def test_connector(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("x")
    assert ex.FolderConnector(str(tmp_path)).files(spark, "sub", "*.txt").count() == 1
    for name in ("../x", "/etc", "C:\\x"):
        with pytest.raises(ValueError):
            ex.FolderConnector(str(tmp_path)).files(spark, name)


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p>")
    (tmp_path / "b.pdf").write_text("no pdf")
    got = {r.name.rpartition("/")[2]: (r.file_type, r.text, r.error) for r in ex.extract_files(ex.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.html": ("html", "x", None), "b.pdf": ("pdf", None, "the content is of another type")}
    with pytest.raises(ValueError):
        ex.read_files(spark, "/a/../b")
