"""Requests as words of known classes: a vocabulary, a lexer in columns, and frames as patterns over classes.

A text becomes an array of lexemes that together are the text, and a string with one letter for the class of each. A frame is a short
pattern over those letters; what it matches is a number of lexemes, so a span of the text. The vocabulary may be replaced by that
of another language without touching a frame.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The words of the language, by what they do in a request.
VOCABULARY = {
    # people and courtesy
    "p": ("hãy", "xin", "vui lòng", "làm ơn"), "y": ("bạn", "nhờ bạn", "nhớ"), "m": ("tôi", "mình", "tui"), "M": ("muốn",), "h": ("giúp", "giùm", "hộ"), "e": ("nhé", "với", "được không"),
    # refusals, joints and remarks
    "x": ("đừng", "không", "không cần", "chưa cần", "không muốn", "khỏi"), "<": ("nhưng", "mà"), "j": ("và", "sau đó", "đồng thời"), "R": ("rồi",), "X": ("ví dụ", "giải thích", "chỉ là câu", "có nghĩa là"),
    # things and how many of them
    "t": ("việc", "task"), "l": ("danh sách",), "T": ("todo",), "N": ("nội dung",), "I": ("id",), "&": ("toàn bộ", "tất cả", "mọi"), "@": ("chỉ", "riêng", "lọc riêng"), "s": ("sau",), "E": ("mỗi dòng một việc",),
    "q": ("các", "những", "một", "hai", "ba", "bốn", "tư", "năm", "sáu", "bảy", "tám", "chín", "mười", "mươi", "trăm", "nghìn", "ngàn", "lẻ", "linh"),
    # changes
    "a": ("thêm", "ghi", "ghi lại", "lưu", "tạo"), "A": ("lưu một task mới có nội dung", "lưu 1 task mới có nội dung"), "o": ("note",), "b": ("bỏ vào todo",), "g": ("cho",), "c": ("hoàn thành",), "k": ("đánh dấu",),
    "u": ("sửa", "cập nhật"), "O": ("đổi nội dung",), "$": ("đổi tên", "sắp xếp"), "=": ("đặt nhắc nhở", "tắt thông báo"), "d": ("xóa", "xoá"), "B": ("bỏ",), "H": ("bỏ hẳn",), "S": ("đặt",), "C": ("chốt", "set"), "P": ("thực hiện", "chạy"),
    # states
    "F": ("đã xong", "đã hoàn thành", "completed"), "!": ("chưa xong", "chưa hoàn thành"), "W": ("làm xong",), "U": ("cập nhật trạng thái",), "Q": ("ứng dụng hãy hỏi xác nhận",), "*": ("đã ghi", "đã lưu", "đã note", "hiện có"), "~": ("đã thêm",),
    # looks and questions
    "r": ("xem", "hiển thị", "liệt kê", "xem lại", "hiện"), "V": ("mở", "show", "kiểm tra", "đọc", "đọc lại", "đưa ra"), "6": ("có", "đang có"), "7": ("nào", "gì"), "8": ("biết",), "9": ("còn",), "0": ("cần",),
    # times
    "D": ("hạn", "deadline"), "5": ("thời hạn", "theo hạn", "có hạn", "thuộc hạn", "theo thời hạn", "có thời hạn", "thuộc thời hạn", "mốc chót", "due", "overdue", "đến kỳ xử lý"), "4": ("đến hạn", "tới hạn"),
    "3": ("quá hạn", "trễ hạn", "đã quá hạn", "đã trễ hạn", "trễ deadline"), "2": ("ngày mai", "mai"), "1": ("hôm nay",), ">": ("hiện tại", "hiện giờ", "bây giờ", "lúc này", "tính đến giờ"),
    "f": ("phải xong", "phải làm xong"), "i": ("lúc", "ở"), "L": ("là",), "v": ("vào",), "Z": ("thành",), "K": ("của",), "G": ("hãy chuyển sang",), "Y": ("hạn mới là",), "J": ("đúng id đó",), "+": ("kèm", "cùng với"),
}
#: Classes of what the vocabulary doesn't have: numbers (with or without #), line ends, final marks, other words, other marks.
NUMBER, LINE_END, FINAL, WORD, MARK, OWN_MARKS = "n", "%", ".", "w", "-", ",;:"

_CLASS_OF = {phrase: letter for letter, phrases in VOCABULARY.items() for phrase in phrases}
_LONGEST: dict[str, int] = {}
for _phrase in _CLASS_OF:
    _first, *_rest = _phrase.split()
    _LONGEST[_first] = max(_LONGEST.get(_first, 1), 1 + len(_rest))
_WORDS = re.compile("(#?[0-9]+(?![\\w\u0300-\u036f])|[\\w\u0300-\u036f]+|\r\n|\r|\n|[^\\w\\s])([^\\S\r\n]*)")


def _letter(word: str) -> str:
    if word[-1].isdigit() and word.lstrip("#").isascii() and word.lstrip("#").isdigit():
        return NUMBER
    if word[0] in "\r\n":
        return LINE_END
    return FINAL if word in ".?!" else word if word in OWN_MARKS else WORD if word[0].isalnum() or word[0] == "_" else MARK


def read(text: str) -> tuple[list[str], str]:
    """The lexemes of a stripped text, each with the blanks that follow it, and their classes: longest phrases of the vocabulary first."""
    words = _WORDS.findall(text)
    low = [w.lower() for w, _ in words]
    found, letters, i = [], [], 0
    while i < len(words):
        taken, letter = 1, None
        for n in range(min(_LONGEST.get(low[i], 0), len(words) - i), 0, -1):
            if all(blank for _, blank in words[i : i + n - 1]) and (letter := _CLASS_OF.get(" ".join(low[i : i + n]))):
                taken = n
                break
        found.append("".join(w + blank for w, blank in words[i : i + taken]))
        letters.append(letter or _letter(words[i][0]))
        i += taken
    return found, "".join(letters)


#: Characters that are read at once: their lexemes take some 20 times the room.
PIECE = 200_000


def pieces(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Texts in order, in lists of about PIECE characters, one at least; null ones as empty."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text or "") > PIECE:
            yield held
            held, size = [], 0
        held.append(text or "")
        size += len(text or "")
    if held:
        yield held


@F.pandas_udf(T.StructType().add("lexemes", T.ArrayType(T.StringType())).add("letters", T.StringType()))
def lexed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """`read` over parts of Arrow batches, so that what a task holds doesn't grow with its texts; a null text has no lexemes."""
    for texts in batches:
        for part in pieces(texts):
            yield pd.DataFrame([read(t) for t in part], columns=["lexemes", "letters"])


def fits(letters: Column, frame: str) -> Column:
    return letters.rlike(frame)


def reach(letters: Column, frame: str, group: int = 0) -> Column:
    """How many lexemes a frame, or one of its groups, takes."""
    return F.length(F.regexp_extract(letters, frame, group))


def span(found: Column, start: Column, count: Column | None = None) -> Column:
    """The text of lexemes from `start` (0 is the first), to the end or `count` of them."""
    return F.array_join(F.slice(found, start + 1, F.size(found) if count is None else count), "")


def letters_from(letters: Column, start: Column) -> Column:
    return F.substring(letters, start + 1, F.length(letters))
