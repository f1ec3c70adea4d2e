"""Names of countries and of their parts."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession

#: Languages in which the names of countries are taken from the Java runtime's locale data.
LANGUAGES = ("en", "de", "fr", "es", "it", "nl", "pt", "pl", "cs", "hu", "ro", "tr", "el", "sv", "da", "nb", "fi", "ca")

# Other common names of countries.
OTHER_NAMES = {
    "AE": "UAE;U.A.E.;Emirates;Dubai;Abu Dhabi;Sharjah", "AR": "Argentine;Argentine Republic", "AT": "Oesterreich;Austrian", "AU": "Oz;Commonwealth of Australia",
    "BE": "Belgie;Belgique;Belgian", "BR": "Brasil;Federative Republic of Brazil", "CH": "Swiss;Swiss Confederation;Helvetia;Confoederatio Helvetica",
    "CN": "PRC;P.R.C.;P.R. China;PR China;Peoples Republic of China;Mainland China;Zhongguo", "CZ": "Czech;Czech Republic;Cesko;Ceska Republika",
    "DE": "Federal Republic of Germany;BRD;FRG;Bundesrepublik Deutschland", "ES": "Kingdom of Spain;Espana", "FI": "Suomi", "FR": "Republique francaise;French Republic",
    "GB": "UK;U.K.;Britain;Great Britain;United Kingdom of Great Britain and Northern Ireland;England;Scotland;Wales;Northern Ireland;Cymru;Alba;G.B.",
    "GR": "Hellas;Hellenic;Hellenic Republic;Ellada", "HK": "Hongkong;Hong Kong;Hong Kong SAR;H.K.", "HU": "Magyarorszag", "IE": "Eire;Republic of Ireland;Irish Republic;ROI",
    "IN": "Bharat;Republic of India;Hindustan", "IL": "State of Israel", "IT": "Italian Republic;Repubblica Italiana", "JP": "Nippon;Nihon;Nippon-koku", "KE": "Republic of Kenya",
    "KR": "Korea;S. Korea;South Korea;Republic of Korea;Korea, Republic of;Korea Republic;R.O.K.;Rep. of Korea;Hanguk", "LU": "Grand Duchy of Luxembourg;Letzebuerg",
    "MX": "Mejico;United Mexican States;Estados Unidos Mexicanos", "NL": "Holland;The Netherlands;Kingdom of the Netherlands;Nederland", "NO": "Norge;Noreg;Kingdom of Norway",
    "NZ": "Aotearoa;N.Z.", "PL": "Rzeczpospolita Polska", "PT": "Portuguese Republic;Republica Portuguesa", "SE": "Kingdom of Sweden", "SG": "Republic of Singapore;S'pore",
    "TR": "Turkiye;Republic of Turkey;Turkiye Cumhuriyeti", "US": "USA;U.S.;U.S.A.;America;United States of America;Vereinigte Staaten von Amerika;Etats-Unis;Estados Unidos;EE.UU.",
    "ZA": "RSA;R.S.A.;Republic of South Africa;Suid-Afrika;S. Africa", "CL": "Republica de Chile", "RO": "Rumania;Roumania", "DK": "Kingdom of Denmark",
    "TW": "R.O.C.", "KP": "DPRK;Democratic Peoples Republic of Korea", "RU": "Russian Federation", "VN": "Viet Nam", "IR": "Islamic Republic of Iran",
}

# The first-level parts of countries.
UNITED_STATES = (
    "Alabama;Alaska;Arizona;Arkansas;California;Colorado;Connecticut;Delaware;Florida;Hawaii;Idaho;Illinois;Indiana;Iowa;Kansas;Kentucky;Louisiana;Maine;Maryland;"
    "Massachusetts;Michigan;Minnesota;Mississippi;Missouri;Montana;Nebraska;Nevada;New Hampshire;New Jersey;New Mexico;New York;North Carolina;North Dakota;Ohio;Oklahoma;"
    "Oregon;Pennsylvania;Rhode Island;South Carolina;South Dakota;Tennessee;Texas;Utah;Vermont;Virginia;Washington;West Virginia;Wisconsin;Wyoming;District of Columbia"
)
STATE_CODES = "CT DC FL HI IA KS MI ND NH NJ NM NV NY OH OK OR RI TX UT VT WA WI WV WY AK"  # those that are no ISO country codes
EUROPE = {
    "GB": "Greater London;Yorkshire;Cornwall;Kent;Lancashire;Ulster", "IE": "Leinster;Munster;Connacht",
    "DE": "Bavaria;Bayern;Hessen;Hesse;Sachsen;Saxony;Berlin;Hamburg;Bremen;Brandenburg;Saarland;Thuringen;Thuringia;Niedersachsen;Lower Saxony;Nordrhein-Westfalen;North Rhine-Westphalia;NRW;Rheinland-Pfalz;Baden-Wurttemberg;Schleswig-Holstein;Mecklenburg-Vorpommern;Sachsen-Anhalt",
    "FR": "Ile-de-France;Bretagne;Brittany;Normandie;Normandy;Occitanie;Nouvelle-Aquitaine;Grand Est;Hauts-de-France;Provence-Alpes-Cote d'Azur;Corse;Alsace;Bourgogne;Pays de la Loire;Auvergne-Rhone-Alpes",
    "IT": "Lombardy;Lombardia;Lazio;Toscana;Tuscany;Veneto;Piemonte;Piedmont;Sicilia;Sicily;Sardegna;Campania;Puglia;Liguria;Emilia-Romagna;Calabria",
    "ES": "Catalonia;Cataluna;Catalunya;Andalucia;Andalusia;Madrid;Galicia;Pais Vasco;Euskadi;Aragon;Navarra;Asturias;Murcia;Comunidad Valenciana",
    "NL": "Noord-Holland;Zuid-Holland;Utrecht;Gelderland;Noord-Brabant;Limburg;Friesland", "BE": "Flanders;Vlaanderen;Wallonia;Wallonie;Brussels;Antwerpen",
    "CH": "Ticino;Zurich;Geneva;Geneve;Genf;Vaud;Bern;Basel;Zug;Valais", "AT": "Tirol;Tyrol;Wien;Vienna;Salzburg;Steiermark;Styria;Karnten;Vorarlberg;Burgenland",
    "PL": "Mazowieckie;Malopolskie;Slaskie;Pomorskie;Wielkopolskie;Dolnoslaskie", "CZ": "Bohemia;Moravia;Praha", "SE": "Skane;Vastra Gotaland;Stockholms lan",
    "NO": "Viken;Vestland;Rogaland", "DK": "Jylland;Sjaelland;Hovedstaden", "FI": "Uusimaa;Lapland;Pirkanmaa", "PT": "Algarve;Alentejo;Madeira;Azores", "GR": "Attica;Attiki;Crete",
    "HU": "Pest;Baranya", "RO": "Transylvania;Transilvania;Cluj;Ilfov", "TR": "Anatolia;Istanbul;Ankara;Izmir",
}
ELSEWHERE = {
    "CA": "Ontario;Quebec;British Columbia;Alberta;Manitoba;Saskatchewan;Nova Scotia;New Brunswick;Newfoundland and Labrador;Prince Edward Island;Yukon;Nunavut",
    "AU": "New South Wales;NSW;Queensland;Victoria;Tasmania;South Australia;Western Australia;Northern Territory", "NZ": "Auckland;Otago;Canterbury;Waikato",
    "JP": "Hokkaido;Tokyo;Osaka;Kyoto;Okinawa;Kanagawa;Aichi", "CN": "Guangdong;Zhejiang;Jiangsu;Sichuan;Shanghai;Beijing;Fujian;Shandong;Hunan;Hubei",
    "IN": "Maharashtra;Karnataka;Tamil Nadu;Gujarat;Kerala;Punjab;Rajasthan;West Bengal;Uttar Pradesh;Telangana;Delhi", "KR": "Gyeonggi;Seoul;Busan;Jeju", "HK": "Kowloon;New Territories",
    "MX": "Jalisco;Nuevo Leon;Yucatan;Oaxaca;Chiapas;Puebla;Veracruz", "BR": "Sao Paulo;Rio de Janeiro;Minas Gerais;Bahia;Parana", "AR": "Cordoba;Mendoza;Santa Fe;Buenos Aires",
    "CL": "Valparaiso;Atacama;Biobio", "ZA": "Gauteng;Western Cape;KwaZulu-Natal;Limpopo;Mpumalanga;Eastern Cape;Free State", "KE": "Nairobi;Mombasa;Kiambu;Nakuru", "IL": "Tel Aviv;Haifa;Galilee",
}


@lru_cache(maxsize=4)
def _from_locales(languages: tuple[str, ...], jvm_id: int) -> tuple[tuple[str, str], ...]:
    jvm = SparkSession.getActiveSession()._jvm
    locale = jvm.java.util.Locale
    shown = [locale(x) for x in languages]
    out = []
    for code in locale.getISOCountries():
        country = locale("", code)
        out += [(code, name) for name in dict.fromkeys(country.getDisplayCountry(x) for x in shown)]
    return tuple(out)


@lru_cache(maxsize=4)
def _codes(jvm_id: int) -> tuple[tuple[str, str], ...]:
    locale = SparkSession.getActiveSession()._jvm.java.util.Locale
    return tuple((code, locale("", code).getISO3Country()) for code in locale.getISOCountries())


def country_codes(spark: SparkSession) -> list[tuple[str, str]]:
    """``(ISO code, spelling)`` for codes: two and three letters of every country, and state codes that are no country's."""
    pairs = _codes(id(spark._jvm))
    return [(a, a) for a, _ in pairs] + list(pairs) + [("US", c) for c in STATE_CODES.split()] + [("GB", "UK")]


def country_names(spark: SparkSession) -> list[tuple[str, str]]:
    """``(ISO code, name)``: names of all countries in ``LANGUAGES``, other common names, and parts of countries."""
    out = list(_from_locales(LANGUAGES, id(spark._jvm)))
    for group in (OTHER_NAMES, {"US": UNITED_STATES}, EUROPE, ELSEWHERE):
        out += [(code, name) for code, names in group.items() for name in names.split(";")]
    return list(dict.fromkeys(out))
