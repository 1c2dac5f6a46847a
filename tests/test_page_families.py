"""Page families and unknown paths, with literal expected names; missing tags."""

import pytest

from tagtrail.functions import urls as U
from tagtrail.operators import clean, quality
from tagtrail.plans import tag_eval as TE

EXPECTED = {
    "/member.php": "member", "//member.html": "member", "/newslist.php": "newslist", "/specialty.html": "specialty", "/authenticate.php": "authenticate",
    "/contact.php": "contact", "/contact_proposal.html": "contact", "/forget.php": "forget", "/inquiry.html": "inquiry", "/sentok.php": "sentok",
    "/brand.html": "brand", "/precursor.php": "precursor", "/new_ecpay_payment.php": "new_ecpay_payment", "/new_ecpay_payment_3d.php": "new_ecpay_payment",
    "/shoppingcart.html": "shopping_cart", "/": "home", "/index.html": "home", "/cheap.php": "home", "/insearch.html": "insearch", "/modify.html": "modify",
    "/order.html": "order", "/new_order_12.html": "order", "/moborderok.html": "order", "/orderview_ab1.html": "orderview", "/oview.html": "orderview",
    "/login_3.php": "login", "/login.html": "login", "/registered.php": "register", "/registerstart.html": "register", "/setbonus_x.html": "getbouns", "/bonus.html": "getbouns",
    "/getgift_a.html": "getgift", "/faq_2.html": "fag", "/faq.php": "fag", "/bulletin_4.html": "bulletin", "/cheapview_5.php": "cheapview",
    "/bastchoice.php": "bastchoice", "/inpage_1_2.html": "inpage", "/index_7.html": "inpage",
    "/cheap_12.html": None, "/favorable_3.html": None, "/about.html": None, "/sitemap.xml": None, "/member_2.php": None, "/index.html/more": None, "/bulletin.html": None,
}


def test_families_by_literal_path(spark):
    df = spark.createDataFrame([(p,) for p in EXPECTED], "url_path string")
    assert {r.url_path: r.f for r in df.select("url_path", U.page_family("url_path").alias("f")).collect()} == EXPECTED
    assert {r.url_path for r in clean.drop_page_families(df).collect()} == {p for p, f in EXPECTED.items() if f is None}


def test_fixture_log_holds_every_family(spark):
    from tagtrail.sources import fixtures as fx

    raw = fx.loads_raw(spark, "/root/testdata/sf0.01")
    families = {r.family for r in clean.page_family_counts(raw).collect()}
    assert families == {f for f in EXPECTED.values()}
    assert {r.url_path for r in clean.unmatched_paths(raw).collect()} == {"/about.html", "/sitemap.xml"}


def test_products_without_tags_are_reported(spark):
    tags = spark.createDataFrame([(1, ["a"]), (3, ["b"])], "pid long, tags array<string>")
    catalogue = spark.createDataFrame([(1,), (2,), (4,)], "pid long")
    assert sorted(r.pid for r in quality.missing_from(catalogue, tags).collect()) == [2, 4]
    with pytest.raises(Exception, match="without tags"):
        TE.restrict_tag_corpus(tags, catalogue, check=True).collect()
