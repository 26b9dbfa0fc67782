from pyspark.sql import functions as F

from mirador import dims
from mirador.functions import dates, geo, images as I, predicates as P, text as T, urls as U


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_keys_and_names(spark):
    L = F.lit
    assert one(spark, T.key(L("  El Niño—Ángel nº 3 "))) == "el nino angel no 3" == T.key_of("  El Niño—Ángel nº 3 ")
    assert one(spark, T.key(L(None).cast("string"))) == ""
    assert one(spark, T.clean_name(L("Catedral | Turismo de una ciudad - Web"))) == "Catedral"
    assert one(spark, T.strip_articles(T.key(L("La la Catedral")))) == "catedral"
    assert one(spark, T.strip_articles(T.key(L("Las")))) == ""
    assert one(spark, T.clean_content(L("Mas lugares de interes  Ficha: Arco de San Juan  Ver mapa . Saber más"))) == "Arco de San Juan."
    assert one(spark, T.is_boilerplate(L("1487 visitas")))
    assert one(spark, T.has_keyword(T.key(L("barrio alto")), "bar")) is False


def test_fold_texts(spark):
    fold = lambda *xs: one(spark, T.fold_texts(F.array(*map(F.lit, xs))))
    assert fold("uno", "uno dos", "uno", "tres", "Ver más", "") == "uno dos tres"
    assert fold("Saber más") == ""


def test_contact(spark):
    assert one(spark, T.phone(F.lit("Tel. +34 947 20 47 12. Fax"))) == "+34 947 20 47 12"
    assert one(spark, T.phone(F.lit("exp. 12345678901234"))) == ""
    assert one(spark, T.address(F.lit("Abierto. Está en la C/ Mayor, 3, Burgos horario de lunes a viernes."))) == "C/ Mayor, 3, Burgos"
    assert one(spark, T.address(F.lit("La plaza se llena de gente en verano."))) == ""


def test_dated_parts(spark):
    t = "12 de mayo de 2026 Feria del libro en la plaza 14 de mayo de 2026 Concierto de órgano"
    assert one(spark, T.relevant_text(F.lit("Concierto de organo"), F.lit(t))) == "14 de mayo de 2026 Concierto de órgano"
    assert one(spark, T.relevant_text(F.lit("Otra cosa"), F.lit(t))) == t


def test_event_dates(spark):
    d = lambda t: tuple(one(spark, dates.event_dates(F.lit(t), F.lit("2026-06-01").cast("date"))))
    assert d("Fecha de inicio: sábado, 2 de mayo, 2026 - 9:30 Fecha de fin: 3 de mayo, 2026 - 21:00") == ("2026-05-02T9:30:00", "2026-05-03T21:00:00")
    assert d("2026-01-02 hasta 2026-01-05") == ("2026-01-02", "2026-01-05")
    assert d("del 3 de agosto al 5 de agosto") == ("2026-08-03T00:00:00", "2026-08-05T00:00:00")
    assert d("del 3 de enero al 5 de enero") == ("2027-01-03T00:00:00", "2027-01-05T00:00:00")
    assert d("el 7 de julio de 2025") == ("2025-07-07T00:00:00", "2025-07-07T00:00:00")
    assert d("30 de brumario de 2025") == ("", "")


def test_urls(spark):
    n = lambda u: one(spark, U.normalize(F.lit(u)))
    assert n("https://a.es/b/?x=1#y") == "https://a.es/b" and n("https://a.es/") == "https://a.es/" and n("mailto:a@b") is None
    a = lambda h: one(spark, U.absolute(F.lit(h), F.lit("https://a.es/b/c.html")))
    assert [a("/x"), a("d"), a("//b.es/y"), a("http://z.es")] == ["https://a.es/x", "https://a.es/b/d", "https://b.es/y", "http://z.es"]
    assert one(spark, U.skipped(F.lit("https://a.es/doc.PDF"))) and one(spark, U.skipped(F.lit("https://a.es/admin/x")))
    assert one(spark, U.foreign_language(F.lit("https://a.es/en/x"), "es")) and not one(spark, U.foreign_language(F.lit("https://a.es/es/x"), "es"))
    assert one(spark, U.site(F.lit("HTTPS://WWW.A.es:8080/x"))) == "a.es"
    assert one(spark, U.with_scheme(F.lit("a.es"))) == "https://a.es"


def test_images(spark):
    noise = lambda u: one(spark, I.is_noise(F.lit(u)))
    assert all(noise(u) for u in ("https://a/x.svg", "https://a/-x.jpg", "https://a/logo_ciudad.png", "https://a/x.png", "https://a/icon/a.jpg"))
    assert not noise("https://a/fotos/catedral-de-burgos.jpg")
    k = T.key(F.lit("Catedral de Burgos"))
    assert one(spark, I.url_score(F.lit("https://a/catedral-de-burgos-1.jpg"), k)) == 100
    assert one(spark, I.url_score(F.lit("https://a/la-catedral.jpg"), k)) == 50
    assert one(spark, I.url_score(F.lit("https://a/otra.jpg"), k)) == 0
    assert one(spark, I.alt_score(F.lit("Vista de la catedral de Burgos"), k)) == 95
    assert one(spark, I.cleaned(F.array(F.lit("https://a/otra.jpg"), F.lit("https://a/catedral.jpg"), F.lit("https://upload.wikimedia.org/z.jpg"), F.lit("https://a/catedral.jpg")), k)) == ["https://a/catedral.jpg", "https://upload.wikimedia.org/z.jpg"]


def test_predicates(spark):
    ed = lambda n, u="https://a.es/x", t=(): one(spark, P.editorial(F.lit(n), F.lit(u), F.array(*map(F.lit, t)).cast("array<string>")))
    assert all(map(ed, ("¿Sabías que la catedral tiene torres?", "5 consejos para viajar", "Semana Santa, día a día", "El Real Alcázar, el palacio más antiguo", "Ruta Regionalista: Redescubre la ciudad")))
    assert not ed("Catedral de Burgos") and not ed("Conciertos en la plaza", "https://a.es/evento/x", ("Event",))
    assert one(spark, P.url_like(F.lit("www.a.es"), F.lit("https://a.es/x")))


def test_geo(spark):
    assert one(spark, geo.address_line(F.lit("Calle Mayor"), F.lit("3"), F.lit("09001"), F.lit("Burgos"), F.lit("burgos"))) == "Calle Mayor 3, 09001, Burgos"
    assert one(spark, geo.address_line(F.lit("Calle Mayor"), F.lit("3"), F.lit("28001"), F.lit("Madrid"), F.lit("Burgos"))) == ""
    assert one(spark, geo.search_radius(F.array(F.lit("X"), F.lit("Church"), F.lit("Beach")))) == 100


def test_tables_are_whole():
    assert (len(dims.SCHEMA_TYPES), len(dims.NAVIGATION_NAMES), len(dims.P31_TYPES), len(dims.TYPE_KEYWORDS), len(dims.CITIES), len(dims.ONTOLOGY)) == (31, 47, 77, 71, 22, 37)
    assert sum(map(len, dims.OSM_TYPES.values())) == 56 - 0 or sum(map(len, dims.OSM_TYPES.values())) > 50
