"""Text functions: words, segmentation, canonical form, syllables."""

import pytest
from pyspark.sql import functions as F

from proselake.functions import text as T


def run(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,want", [("Don’t stop, it's über-fine 12 x2!", ["Don’t", "stop", "it's", "über", "fine", "x"]), ("", []), ("—", [])])
def test_words(spark, text, want):
    assert run(spark, T.words, text) == want


def test_paragraphs_and_sentences(spark):
    t = "One two. Three!\nFour?\n \n“Five.” Six\n\n* * *\n\nSeven…"
    assert run(spark, T.paragraphs, t) == ["One two. Three! Four?", "“Five.” Six", "Seven…"]
    assert run(spark, T.sentences, t) == [["One two.", "Three!", "Four?"], ["“Five.”", "Six"], ["Seven…"]]


def test_quotations(spark):
    t = 'He said "one" and “two\nlines” then "open'
    assert run(spark, T.quotations, t) == ["one", "two\nlines", "open"]
    assert run(spark, T.narration, t) == "He said  and  then "


def test_canonical(spark):
    t = "junk\r\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\r\nTitle\r\n=====\r\n\r\n## Sub\r\nBody text.\r\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\r\nmore"
    assert run(spark, T.body, t).split() == ["Body", "text."]
    assert run(spark, T.strip_gutenberg, "no markers") == "no markers"
    assert run(spark, T.normalize_quotes, "“a” ‘b’") == "\"a\" 'b'"


def test_transcript(spark):
    kept, share = spark.createDataFrame([("ann: one two\nplain three\nbob_2 : four",)], "x string").select(*T.transcript_parts(F.col("x"))).first()
    assert kept == "plain three" and share == pytest.approx(100 * 5 / 7)


SYLLABLES = {
    "whole": 1, "while": 1, "table": 2, "looked": 1, "wanted": 2, "times": 1, "horses": 2, "something": 2, "hopeful": 2, "therefore": 2, "poem": 2, "idea": 3, "quiet": 2, "going": 2,
    "science": 2, "fire": 2, "hour": 2, "nation": 2, "cruel": 2, "curious": 3, "the": 1, "mrs": 2, "isn't": 2, "society": 4, "value": 2, "settled": 2, "places": 2, "carefully": 3, "john's": 1, "rhythm": 1,
}


def test_syllables(spark):
    rows = spark.createDataFrame([(w,) for w in SYLLABLES], "w string").select("w", T.syllables(F.col("w")).alias("n")).collect()
    assert {r.w: r.n for r in rows} == SYLLABLES


# counted by ear
HEARD = (
    "fire 2 hour 2 poem 2 science 2 cruel 2 idea 3 quiet 2 going 2 being 2 playing 2 curious 3 society 4 area 3 inquired 3 looked 1 seemed 1 times 1 gives 1 while 1 whole 1 "
    "smile 1 value 2 something 2 therefore 2 carefully 3 movement 2 mr 2 mrs 2 isn't 2 couldn't 2 table 2 little 2 wanted 2 horses 2 places 2 settled 2 hundred 2 agreed 2 "
    "people 2 nation 2 sea 1 tea 1 free 1 four 1 your 1 power 2 quality 3 square 1 patient 2 tales 1 tables 2 filled 1 a 1 the 1 he 1 be 1 we 1 she 1 me 1 river 2 beautiful 3 "
    "evening 2 every 2 mountain 2 station 2 ocean 2 special 2 marriage 2 carriage 2 question 2 religion 3 ancient 2 create 2 created 3 real 1 theatre 3 museum 3 dial 2 lion 2 "
    "violet 3 piano 3 radio 3 video 3 guide 1 guess 1 league 1 queen 1 quick 1 unique 2 language 2 persuade 2 actual 3 usual 3 duel 2 fuel 2 blue 1 argue 2 continue 3 due 1 "
    "eye 1 eyes 1 die 1 died 1 lie 1 tie 1 tied 1 cried 1 tried 1 carried 2 married 2 studies 2 cities 2 field 1 friend 1 believe 2 received 2 height 1 neighbour 2 foreign 2 "
    "either 2 reign 1 seeing 2 doing 2 saying 2 flying 2 crying 2 yes 1 year 1 young 1 beyond 2 lawyer 2 player 2 loyal 2 royal 2 voyage 2 flower 2 tower 2 town 1 snow 1 "
    "follow 2 allowed 2 house 1 houses 2 noise 1 voices 2 judges 2 washes 2 boxes 2 watches 2 bridge 1 bridges 2 breathe 1 bathed 1 asked 1 jumped 1 danced 1 needed 2 added 2 "
    "united 3 ended 2 handled 2 troubled 2 angle 2 whistle 2 castle 2 apple 2 rule 1 rules 1 homeless 2 useful 2 lovely 2 lonely 2 careless 2 somewhere 2 sometimes 2 someone 2 "
    "before 2 forehead 2 safety 2 ninety 2 nineteen 2 experience 4 audience 3 patience 2 conscience 2 obedient 4 client 2 diet 2 variety 4 anxious 2 gracious 2 obvious 3 "
    "various 3 serious 3 previous 3 delicious 3 courageous 3 gorgeous 2 pigeon 2 surgeon 2 leopard 2 theory 3 geography 4 neon 2 pleasure 2 measure 2 ready 2 heart 1 learned 1 "
    "korea 3 fear 1 dear 1 poetry 3 poet 2 does 1 goes 1 shoe 1 toe 1 canoe 2 doe 1 book 1 blood 1 cooperate 4 coat 1 road 1 oasis 3 fluid 2 ruin 2 ruined 2 suit 1 fruit 1 "
    "build 1 guilt 1 juice 1 genuine 3 vacuum 3 mutual 3 equal 2 casual 3 january 4 february 4 influence 3 fluent 2 truly 2 rhythm 1 prism 1 chasm 1 hmm 1 brr 1 x 1 my 1 try 1 "
    "system 2 type 1 mystery 3 buy 1 guy 1 enough 2 though 1 through 1 thought 1 daughter 2 caught 1 laugh 1 chaos 2 naive 2 said 1 again 2 captain 2 they 1 money 2 valley 2 "
    "obey 2 few 1 new 1 jewel 2 view 1 review 2 window 2 sorrow 2 tomorrow 3 animal 3 another 3 remember 3 important 3 different 3 interest 3 government 3 suddenly 3 "
    "immediately 5 especially 4 necessary 4 imagination 5 university 5"
).split()


def test_syllables_by_ear(spark):
    """At least 97 % of the words tried agree; those that don't are kept in the list."""
    want = dict(zip(HEARD[::2], map(int, HEARD[1::2])))
    rows = spark.createDataFrame([(w,) for w in want], "w string").select("w", T.syllables(F.col("w")).alias("n")).collect()
    wrong = {r.w: r.n for r in rows if r.n != want[r.w]}
    assert len(wrong) <= 0.03 * len(want), wrong
    assert all(r.n == 1 for r in spark.createDataFrame([("",), ("'",), ("hmm",), ("x",)], "w string").select(T.syllables(F.col("w")).alias("n")).collect())


def test_shapes_and_marks(spark):
    assert run(spark, T.word_shape, "McDonald’s") == "XxXx’x"
    assert run(spark, T.mark_skeleton, "Wait... no -- yes, “ok”!") == "...--,“”!"
    assert run(spark, lambda c: T.mark_name(c), "...") == "ellipsis" and run(spark, lambda c: T.mark_name(c), "--") == "em_dash"
