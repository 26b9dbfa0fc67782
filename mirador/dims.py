"""The fixed tables of the domain, and DataFrames of them. All are small by nature: a few dozen rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Schema.org types and the tourist types they stand for.
SCHEMA_TYPES = {
    "TouristAttraction": "TouristAttractionSite", "Museum": "Museum", "Church": "Church", "LandmarksOrHistoricalBuildings": "HistoricalOrCulturalResource",
    "HistoricBuilding": "HistoricalOrCulturalResource", "CivicStructure": "Monument", "GovernmentBuilding": "Monument", "LocalBusiness": "FoodEstablishment",
    "FoodEstablishment": "FoodEstablishment", "Restaurant": "Restaurant", "CafeOrCoffeeShop": "CafeOrCoffeShop", "BarOrPub": "Bar", "Hotel": "Hotel",
    "Lodging": "AccommodationEstablishment", "Hostel": "Hostel", "BedAndBreakfast": "GuestHouse", "PerformingArtsTheater": "Theater", "MovieTheater": "MovieTheater",
    "ArtGallery": "ArtGallery", "Park": "NaturalPark", "Event": "Event", "MusicEvent": "Event", "ExhibitionEvent": "Event", "Festival": "Event", "TheaterEvent": "Event",
    "NightClub": "NightClub", "TouristInformationCenter": "TouristAttractionSite", "Library": "Library", "Aquarium": "Aquarium", "Zoo": "Zoo", "Winery": "Winery",
}

# Names that are navigation, as keys.
NAVIGATION_NAMES = (
    "inicio", "home", "que ver", "que hacer", "donde dormir", "dormir", "comer", "comprar", "agenda", "actualidad", "contacto", "descubre", "gastronomia", "mapa web",
    "buscar", "menu", "para tocar la catedral", "planifica tu viaje", "turismo", "turismo en familia", "sumergete", "profesionales", "servicios", "blog", "noticias",
    "novedades", "informacion practica", "alojamientos", "area de profesionales", "noticias del sector", "datos api", "metro", "salud", "policia", "cultura", "deporte",
    "artesania", "artesanos", "ocio", "parques", "ceramica", "navidad", "por carretera", "desde triana", "apuntate a la newsletter", "historia de sevilla", "sevilla es cine",
)

# Keywords and the types they stand for, in the order that breaks ties.
TYPE_KEYWORDS = (
    ("catedral", "Cathedral"), ("iglesia", "Church"), ("basilica", "Basilica"), ("capilla", "Chapel"), ("monasterio", "Monastery"), ("convento", "Convent"), ("cartuja", "Monastery"),
    ("ermita", "Church"), ("santuario", "Sanctuary"), ("museo", "Museum"), ("archivo", "Museum"), ("biblioteca", "Library"), ("galeria de arte", "ArtGallery"), ("galeria", "ArtGallery"),
    ("sala de exposiciones", "ExhibitionHall"), ("centro cultural", "CultureCentre"), ("centro de arte", "ArtGallery"), ("castillo", "Castle"), ("alcazar", "Alcazar"), ("palacio", "Palace"),
    ("muralla", "Wall"), ("torre", "Tower"), ("arco", "Arch"), ("puente", "Bridge"), ("acueducto", "Aqueduct"), ("yacimiento", "ArcheologicalSite"), ("anfiteatro", "Amphitheatre"),
    ("plaza", "Square"), ("jardin", "Garden"), ("mirador urbano", "UrbanViewPoint"), ("mirador", "UrbanViewPoint"), ("monumento", "Monument"), ("teatro", "Theater"), ("auditorio", "Auditorium"),
    ("parque natural", "NaturalPark"), ("parque", "NaturalPark"), ("sendero", "Trail"), ("cueva", "Cave"), ("playa", "Beach"), ("montana", "Mountain"), ("valle", "Valley"),
    ("mirador natural", "NaturalViewPoint"), ("ruta", "Route"), ("camino", "Route"), ("festival", "Event"), ("semana santa", "Event"), ("concierto", "Event"), ("feria", "Event"),
    ("fiesta", "Event"), ("eclipse", "Event"), ("visita guiada", "Tour"), ("pulsera turistica", "Tour"), ("experiencia", "DestinationExperience"), ("hotel", "Hotel"), ("hostal", "Hostal"),
    ("albergue", "Hostel"), ("casa rural", "RuralHouse"), ("restaurante", "Restaurant"), ("cafeteria", "CafeOrCoffeShop"), ("bar", "Bar"), ("bodega", "Winery"),
    ("sala de conciertos", "MusicVenue"), ("centro de biodiversidad", "TouristAttractionSite"), ("mercado", "TraditionalMarket"), ("pabellon", "ExhibitionHall"), ("maestranza", "BullRing"),
    ("estadio", "SportsCentre"), ("muelle", "Monument"), ("costurero", "Monument"), ("corpus christi", "Event"), ("semana de la musica", "Event"),
)

# Wikidata classes (instance of) and the types they stand for; where one was given twice, the last.
P31_TYPES = {
    "Q16970": "Church", "Q2977": "Cathedral", "Q44613": "Monastery", "Q108325": "Chapel", "Q317557": "Convent", "Q1128397": "Church", "Q34627": "Church", "Q698831": "Church", "Q160742": "Church",
    "Q15217609": "Basilica", "Q120560": "Basilica", "Q33506": "Museum", "Q207694": "Museum", "Q1030034": "Museum", "Q2143825": "Route", "Q655686": "Museum", "Q1279963": "Museum", "Q7075": "Library",
    "Q166118": "Museum", "Q1281754": "ArtGallery", "Q24699794": "CultureCentre", "Q15243209": "ExhibitionHall", "Q16560": "Palace", "Q23413": "Castle", "Q39715": "Monument", "Q811979": "Monument",
    "Q4989906": "Monument", "Q12280": "Bridge", "Q16831714": "Tower", "Q57821": "Tower", "Q839954": "ArcheologicalSite", "Q15816": "ArcheologicalSite", "Q24354": "Theater", "Q18674003": "Auditorium",
    "Q1060829": "Auditorium", "Q483110": "SportsCentre", "Q1076486": "TouristAttractionSite", "Q83405": "BullRing", "Q130003": "SportsCentre", "Q46169": "NaturalPark", "Q179049": "NaturalPark",
    "Q22698": "NaturalPark", "Q22746": "Garden", "Q1107656": "Garden", "Q4022": "NaturalPark", "Q40080": "Beach", "Q35509": "Cave", "Q8502": "Mountain", "Q2020153": "Trail", "Q174782": "Square",
    "Q1004598": "Square", "Q11707": "Restaurant", "Q259240": "Hotel", "Q131734": "Winery", "Q168796": "TraditionalMarket", "Q573719": "TraditionalMarket", "Q628179": "Route", "Q1137285": "Route",
    "Q27686": "Hotel", "Q2631695": "Hostel", "Q2041543": "RuralHouse", "Q256020": "Camping", "Q1228895": "Winery", "Q22674": "TraditionalMarket", "Q44856": "Church", "Q1329623": "Church",
    "Q1161515": "Monastery", "Q2298524": "Monastery", "Q56242695": "Monastery", "Q54074": "Monastery", "Q1007894": "CultureCentre", "Q16917": "NaturalPark", "Q1321977": "NaturalPark",
    "Q23790": "NaturalPark", "Q2763074": "Trail", "Q570116": "TouristAttractionSite", "Q1497375": "TouristAttractionSite",
}

# Map categories and the types they stand for.
OSM_TYPES = {
    "amenity": {"place_of_worship": "Church", "theatre": "Theater", "cinema": "MovieTheater", "library": "Library", "restaurant": "Restaurant", "cafe": "CafeOrCoffeShop", "bar": "Bar", "pub": "Pub", "nightclub": "NightClub", "marketplace": "TraditionalMarket", "museum": "Museum"},
    "historic": {"castle": "Castle", "church": "Church", "monastery": "Monastery", "archaeological_site": "ArcheologicalSite", "ruins": "ArcheologicalSite", "fort": "Castle", "memorial": "Monument", "monument": "Monument", "bridge": "Bridge", "tower": "Tower", "palace": "Palace", "city_gate": "Monument", "aqueduct": "Monument", "wayside_cross": "Monument"},
    "tourism": {"museum": "Museum", "gallery": "ArtGallery", "hotel": "Hotel", "hostel": "Hostel", "guest_house": "GuestHouse", "attraction": "TouristAttractionSite", "viewpoint": "UrbanViewPoint", "aquarium": "Aquarium", "theme_park": "AmusementPark", "zoo": "Zoo", "artwork": "Monument", "information": "TouristAttractionSite"},
    "natural": {"beach": "Beach", "peak": "Mountain", "cave_entrance": "Cave", "volcano": "Mountain"},
    "leisure": {"garden": "Garden", "park": "NaturalPark", "nature_reserve": "NaturalPark", "stadium": "SportsCentre", "sports_centre": "SportsCentre", "swimming_pool": "SwimmingPool", "golf_course": "GolfCourse"},
    "boundary": {"national_park": "NaturalPark", "protected_area": "NaturalPark"},
    "building": {"cathedral": "Cathedral", "church": "Church", "monastery": "Monastery", "palace": "Palace", "stadium": "SportsCentre"},
    "place": {"square": "Square"},
}

# The ontology that holds when no other is given (name, parent).
ONTOLOGY = (
    ("HistoricalOrCulturalResource", ""), ("Cathedral", "HistoricalOrCulturalResource"), ("Church", "HistoricalOrCulturalResource"), ("Basilica", "HistoricalOrCulturalResource"),
    ("Chapel", "HistoricalOrCulturalResource"), ("Monastery", "HistoricalOrCulturalResource"), ("Convent", "HistoricalOrCulturalResource"), ("Museum", "HistoricalOrCulturalResource"),
    ("ArtGallery", "HistoricalOrCulturalResource"), ("Castle", "HistoricalOrCulturalResource"), ("Palace", "HistoricalOrCulturalResource"), ("Monument", "HistoricalOrCulturalResource"),
    ("CultureCentre", "HistoricalOrCulturalResource"), ("Theater", "HistoricalOrCulturalResource"), ("Auditorium", "HistoricalOrCulturalResource"), ("Garden", "HistoricalOrCulturalResource"),
    ("Square", "HistoricalOrCulturalResource"), ("ArcheologicalSite", "HistoricalOrCulturalResource"), ("TouristAttractionSite", "HistoricalOrCulturalResource"), ("NaturalResource", ""),
    ("NaturalPark", "NaturalResource"), ("Trail", "NaturalResource"), ("Beach", "NaturalResource"), ("Cave", "NaturalResource"), ("Mountain", "NaturalResource"), ("Route", ""), ("Event", ""),
    ("TourismService", ""), ("Tour", "TourismService"), ("Hotel", ""), ("Hostel", ""), ("RuralHouse", ""), ("Restaurant", ""), ("Bar", ""), ("CafeOrCoffeShop", ""), ("NightClub", ""), ("Pub", ""),
)
# Branches of which all classes can be chosen, and single classes beside them.
ROOTS = ("HistoricalOrCulturalResource", "NaturalResource", "Route", "Event", "TourismService")
FACILITIES = (
    "AccommodationEstablishment", "Aparthotel", "Camping", "GuestHouse", "Hostal", "Hostel", "Hotel", "Lodge", "Motel", "Residence", "Resort", "RuralHouse", "VacationRental", "FoodEstablishment", "Bar",
    "BeachBar", "Brewery", "CafeOrCoffeShop", "CocktailBar", "GastronomicMarket", "Inn", "Restaurant", "Tavern", "WineBar", "LeisureAndCultureFacility", "AmusementPark", "Aquarium", "ArtGallery",
    "ExhibitionHall", "MovieTheater", "Planetarium", "Zoo", "EventAttendanceFacility", "Auditorium", "BullRing", "CongressCentre", "MusicVenue", "PartyAndEntertainmentFacility", "NightClub", "Pub",
    "SportFacility", "GolfCourse", "MultiAdventureCentre", "SportsCentre", "SwimmingPool", "WinterSportsResort", "AgrotourismFacility", "Winery", "Vineyard", "TraditionalMarket",
)
#: The types that may be chosen under this ontology: all of the roots' branches, and the facilities it has.
ALLOWED = tuple(n for n, p in ONTOLOGY if n in ROOTS or p in ROOTS or n in FACILITIES)

# The cities known by name (key, name, lat, lng, radius in km), in the order in which they are tried.
CITIES = (
    ("avila", "Ávila", 40.65660, -4.70024, 20.0), ("barcelona", "Barcelona", 41.38879, 2.15899, 40.0), ("bilbao", "Bilbao", 43.26300, -2.93500, 30.0), ("burgos", "Burgos", 42.34399, -3.69691, 25.0),
    ("cadiz", "Cádiz", 36.52700, -6.28850, 25.0), ("cordoba", "Córdoba", 37.88839, -4.77938, 30.0), ("girona", "Girona", 41.98311, 2.82493, 20.0), ("granada", "Granada", 37.17604, -3.58881, 30.0),
    ("leon", "León", 42.59873, -5.57028, 25.0), ("madrid", "Madrid", 40.41650, -3.70256, 40.0), ("malaga", "Málaga", 36.72016, -4.42034, 30.0), ("pamplona", "Pamplona", 42.81272, -1.64323, 20.0),
    ("salamanca", "Salamanca", 40.96527, -5.66362, 25.0), ("san sebastian", "San Sebastián", 43.31828, -1.98143, 25.0), ("santander", "Santander", 43.46472, -3.80444, 25.0),
    ("santiago de compostela", "Santiago de Compostela", 42.87854, -8.54451, 20.0), ("segovia", "Segovia", 40.94803, -4.11839, 20.0), ("sevilla", "Sevilla", 37.38909, -5.98446, 35.0),
    ("toledo", "Toledo", 39.86283, -4.02732, 25.0), ("valencia", "Valencia", 39.46990, -0.37630, 35.0), ("valladolid", "Valladolid", 41.65225, -4.72453, 35.0), ("zaragoza", "Zaragoza", 41.65606, -0.87734, 35.0),
)

# Coverage of content blocks.
TOURIST_SIGNALS = ("arte", "basilica", "capilla", "cartuja", "castillo", "catedral", "centro cultural", "concierto", "exposicion", "festival", "iglesia", "monasterio", "monumento", "museo", "palacio", "parque", "patrimonio", "ruta", "semana santa", "teatro", "turismo", "visita")
NAVIGATION_TITLES = ("descubre", "gastronomia", "inicio", "planifica tu viaje", "profesionales", "que hacer", "que ver", "turismo en familia")
NAVIGATION_MARKERS = ("saber mas", "contacto", "aviso legal", "politica de privacidad", "accesibilidad", "newsletter", "descarga material")
NOISE_MARKERS = ("se ha producido un error al procesar la plantilla", "the following has evaluated to null", "document cookie")

# Article headlines.
EDITORIAL_PREFIXES = ("sabias que", "conoces", "curiosidades", "breve historia de", "redescubre", "descubre esta", "disfruta de", "consejos para", "consejos y", "gastronomia de", "opciones unicas", "los tesoros de", "las claves de", "escapada a", "una ruta por", "la unica")

# Pages that are not followed.
SKIP_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "css", "js", "json", "xml", "txt", "csv", "mp3", "mp4", "avi", "mov", "wmv", "flv", "ogg", "wav")
SKIP_SEGMENTS = ("login", "logout", "admin", "api", "register", "signup", "search", "feed", "rss", "sitemap", "tag", "category", "wp-admin", "wp-login", "wp-content", "wp-json", "cart", "checkout", "account", "password")
LANGUAGES = ("af", "ar", "bg", "bn", "ca", "cs", "cy", "da", "de", "el", "en", "es", "et", "eu", "fi", "fr", "gl", "he", "hr", "hu", "hy", "id", "it", "ja", "ka", "ko", "lt", "lv", "mk", "ml", "mt", "nl", "no", "pl", "pt", "ro", "ru", "sk", "sl", "sq", "sr", "sv", "sw", "th", "tr", "uk", "ur", "vi", "zh")
LISTING_SEGMENTS = ("blog", "noticias", "actualidad", "novedades", "agenda")
EVENT_SEGMENTS = ("agenda", "eventos", "evento", "agenda-cultural", "actividades")

# Images that show no place, and images.
BLOCKED_TOKENS = ("app", "apple", "arrow", "blog", "boton", "button", "calendar", "chevron", "clock", "desliza", "facebook", "googleplay", "icon", "instagram", "linkedin", "logo", "logotipo", "map", "pin", "menu", "nav", "promo", "promocional", "rrss", "social", "svg", "twitter", "whatsapp", "x", "youtube")
BLOCKED_SUBSTRINGS = ("logo", "logovidriera", "desliza", "twitter", "facebook", "instagram", "whatsapp", "ruta-ia", "rutaia", "infoicons", "info icons", "map pin")
SOCIAL_FILES = ("x png", "x jpg", "twitter x 1 png")
IMAGE_EXTENSIONS = ("apng", "avif", "gif", "jpeg", "jpg", "png", "webp")
TRUSTED_HOSTS = ("commons.wikimedia.org", "upload.wikimedia.org")
GENERIC_TOKENS = ("logo", "facebook", "instagram", "twitter", "whatsapp", "desliza", "arrow", "boton", "saber", "mas", "app", "googleplay", "apple", "logovidriera", "promocional")
IMAGE_STOPWORDS = ("de", "del", "la", "las", "los", "el", "y", "en", "san", "santa", "maria", "real", "burgos", "centro", "ciudad", "visita", "forum")
# Words that don't tell names apart, and leading articles.
NAME_STOPWORDS = ("de", "del", "la", "las", "los", "el", "en", "por", "the", "of", "para", "con", "que", "sus", "una", "uno")
LABEL_STOPWORDS = ("de", "del", "la", "las", "los", "el", "y", "en", "san", "santa", "real", "nueva", "nuevo")
MERGE_ARTICLES = ("el", "la", "los", "las", "un", "una", "the", "a", "an", "le", "les")
RESOLVE_ARTICLES = ("el", "la", "los", "las", "un", "una", "the", "a", "an")
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
EVENT_URIS = ("Festival", "MusicEvent", "TheaterEvent", "ExhibitionEvent", "SportsEvent")


def keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(TYPE_KEYWORDS)], "keyword string, type string, ord int")


def p31(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(P31_TYPES.items()), "qid string, type string")


def osm(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, k, t) for c, m in OSM_TYPES.items() for k, t in m.items()], "category string, kind string, type string")


def ontology(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ONTOLOGY), "name string, parent string")


def cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CITIES)], "ord int, key string, name string, lat double, lng double, radius_km double")
