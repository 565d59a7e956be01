from sievework.llm import secrets


def lexed(text):
    return [text[a:b] for k, a, b in secrets.all_spans(text) if k == "lexed"]


def test_all_pieces_of_a_constant_reach_the_name():
    pieces = [f"q{i}Zr7" for i in range(30)]
    bound = "KEY = " + " + ".join(f'"{p}"' for p in pieces) + "\n"
    assert lexed(bound + "private_key = KEY\n") == pieces
    assert lexed(bound + "OTHER = KEY\nLAST = OTHER\nprivate_key = LAST\n") == pieces


def test_names_that_double_do_not_blow_up():
    text = 'K0 = "q8Zr71Lm"\n' + "".join(f"K{i + 1} = K{i} + K{i}\n" for i in range(200)) + "private_key = K200\n"
    assert lexed(text) == ["q8Zr71Lm"]


def test_rest_of_a_literal_behind_a_base_span():
    assert lexed('password = "abcdefgh1!rest"') == ["!rest"]
    assert lexed('password = "abcDEF123456"') == []


def test_open_comments_and_many_pairs_take_linear_time():
    import time

    began = time.time()
    assert secrets.lexed_spans("password " + "/* " * 400_000) == []
    text = "password = 'abcd1234efgh!x'\n" * 20_000
    assert len(secrets.all_spans(text)) >= 20_000
    assert time.time() - began < 30


def test_a_comment_hides_its_literals_and_an_open_one_none():
    assert secrets.lexed_spans("/* my_secret_thing = 'Zx81kq?77ab!' */ a = 1") == []
    assert len(secrets.lexed_spans("/* c */ my_private_key = 'Zx81kq?77ab!' /* open")) == 1
