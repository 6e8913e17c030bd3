"""Word lists, and the ways in which a text is held against one: as one folded pattern for a yes or no, as an ordered
chain for a first match, and as a filtered array for a count or list. No list is joined; each is a literal of the plan.

Fixed values: the lists below.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

COLLECT_CITIES = [
    "Hyderabad", "Bengaluru", "Bangalore", "Mumbai", "Pune", "Chennai", "Delhi", "New Delhi", "Gurugram", "Gurgaon", "Noida", "Kolkata", "Kochi",
    "Ahmedabad", "Jaipur", "Chandigarh", "Bhubaneswar", "Lucknow", "Indore", "Coimbatore", "Visakhapatnam", "Vijayawada", "Thiruvananthapuram",
    "Mysuru", "Mysore", "Nagpur", "Surat", "Vadodara", "Goa",
]
COLLECT_STATES = [
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand",
    "Karnataka", "Kerala", "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Punjab", "Rajasthan", "Sikkim",
    "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand", "West Bengal", "Delhi",
]
FOREIGN_COUNTRIES = [
    "united states", "usa", "u.s.a", "u.s.", "canada", "united kingdom", "uk", "england", "scotland", "australia", "new zealand", "germany",
    "france", "spain", "italy", "netherlands", "ireland", "singapore", "malaysia", "indonesia", "philippines", "japan", "south korea", "korea",
    "china", "brazil", "mexico", "poland", "sweden", "norway", "denmark", "switzerland", "israel", "uae", "dubai", "abu dhabi",
]
FOREIGN_CITIES = [
    "raleigh", "durham", "charlotte", "new york", "los angeles", "san francisco", "seattle", "boston", "chicago", "austin", "dallas", "houston",
    "washington dc", "washington, dc", "atlanta", "denver", "miami", "toronto", "vancouver", "london", "manchester", "sydney", "melbourne", "berlin",
    "paris", "amsterdam", "singapore",
]
COLLECT_TOPICS = [
    "cybersecurity", "cyber security", "information security", "infosec", "application security", "appsec", "cloud security", "ai security",
    "network security", "soc", "blue team", "red team", "penetration testing", "pentesting", "ethical hacking", "vapt", "vulnerability",
    "bug bounty", "digital forensics", "dfir", "incident response", "threat intelligence", "malware", "osint", "grc", "iam", "identity security",
    "ctf", "capture the flag", "owasp", "zero trust", "ransomware", "devsecops", "security operations", "cyber crime", "cybercrime",
    "digital security", "privacy engineering",
]
COLLECT_TYPES = [
    "event", "meetup", "conference", "workshop", "webinar", "summit", "training", "seminar", "networking", "community", "ctf", "hackathon", "talk",
    "session", "bootcamp",
]
INVALID_TITLES = [
    "global events", "regional events", "partner events", "all events", "upcoming events", "past events", "event calendar", "events calendar",
    "event listings", "events listings", "events directory", "event directory", "event archive", "events archive", "chapters", "all chapters",
    "find events", "browse events", "view all events", "see all events", "discover events", "discover", "event search", "search events", "sign in",
    "login", "register", "sign up",
]

RSS_EVENT_WORDS = [
    "event", "meetup", "conference", "workshop", "summit", "webinar", "ctf", "hackathon", "networking", "seminar", "community", "session", "talk",
    "training", "bootcamp", "challenge",
]
RSS_ALIASES = {
    "bangalore": "Bengaluru", "bengaluru": "Bengaluru", "bombay": "Mumbai", "mumbai": "Mumbai", "calcutta": "Kolkata", "kolkata": "Kolkata",
    "madras": "Chennai", "chennai": "Chennai", "gurgaon": "Gurugram", "gurugram": "Gurugram", "new delhi": "Delhi", "delhi": "Delhi",
    "noida": "Noida",
}
RSS_TRUST = {
    "owasp.org": 30, "null.community": 30, "securitybsides.com": 30, "meetup.com": 20, "eventbrite.com": 20, "lu.ma": 20, "github.com": 15,
    "linkedin.com": 15,
}

PLACES = [
    "Hyderabad", "Bengaluru", "Bangalore", "Mumbai", "Pune", "Chennai", "Delhi", "New Delhi", "Noida", "Gurugram", "Gurgaon", "Kolkata", "Kochi",
    "Ahmedabad", "Jaipur", "Chandigarh", "Bhubaneswar", "Lucknow", "Indore", "Coimbatore", "Visakhapatnam",
]
CITY_STATES = {
    "Hyderabad": "Telangana", "Bengaluru": "Karnataka", "Bangalore": "Karnataka", "Mumbai": "Maharashtra", "Pune": "Maharashtra",
    "Chennai": "Tamil Nadu", "Delhi": "Delhi", "New Delhi": "Delhi", "Noida": "Uttar Pradesh", "Gurugram": "Haryana", "Gurgaon": "Haryana",
    "Kolkata": "West Bengal", "Kochi": "Kerala", "Ahmedabad": "Gujarat", "Jaipur": "Rajasthan", "Chandigarh": "Chandigarh", "Bhubaneswar": "Odisha",
    "Lucknow": "Uttar Pradesh", "Indore": "Madhya Pradesh", "Coimbatore": "Tamil Nadu", "Visakhapatnam": "Andhra Pradesh", "Mysuru": "Karnataka",
    "Mysore": "Karnataka", "Thiruvananthapuram": "Kerala", "Trivandrum": "Kerala", "Surat": "Gujarat", "Vadodara": "Gujarat",
    "Nagpur": "Maharashtra", "Nashik": "Maharashtra", "Patna": "Bihar", "Bhopal": "Madhya Pradesh", "Ranchi": "Jharkhand", "Guwahati": "Assam",
    "Kanpur": "Uttar Pradesh", "Agra": "Uttar Pradesh", "Amritsar": "Punjab", "Vijayawada": "Andhra Pradesh", "Mangaluru": "Karnataka",
    "Mangalore": "Karnataka", "Dehradun": "Uttarakhand",
}
LEX_CITIES = list(CITY_STATES)
LEX_STATES = [*COLLECT_STATES, *["Chandigarh", "Jammu and Kashmir", "Ladakh", "Puducherry"]]
LEX_ALIASES = {
    "bangalore": "Bengaluru", "bengaluru": "Bengaluru", "bombay": "Mumbai", "mumbai": "Mumbai", "madras": "Chennai", "chennai": "Chennai",
    "calcutta": "Kolkata", "kolkata": "Kolkata", "gurgaon": "Gurugram", "gurugram": "Gurugram", "new delhi": "Delhi", "delhi": "Delhi",
    "mysore": "Mysuru", "mysuru": "Mysuru", "trivandrum": "Thiruvananthapuram", "thiruvananthapuram": "Thiruvananthapuram", "mangalore": "Mangaluru",
    "mangaluru": "Mangaluru",
}
LEX_TOPICS = [
    "cybersecurity", "cyber security", "information security", "infosec", "application security", "appsec", "web security", "api security",
    "cloud security", "network security", "identity security", "identity and access management", "identity access management", "iam", "zero trust",
    "ai security", "artificial intelligence security", "ai cybersecurity", "generative ai security", "machine learning security", "soc",
    "security operations", "blue team", "red team", "incident response", "threat intelligence", "threat hunting", "penetration testing",
    "penetration test", "pentesting", "ethical hacking", "vapt", "vulnerability assessment", "vulnerability management", "bug bounty", "bugbounty",
    "digital forensics", "digital forensic", "dfir", "digital investigation", "osint", "open source intelligence", "grc", "governance",
    "risk management", "cyber risk", "information risk", "compliance", "malware", "ransomware", "reverse engineering", "cyber crime", "cybercrime",
    "cyber fraud", "ctf", "capture the flag", "cyber challenge", "security engineering", "security architecture", "security awareness",
    "security testing", "security research", "secure coding", "devsecops", "sast", "dast", "sca", "container security", "kubernetes security",
    "endpoint security", "mobile security", "iot security", "automotive security", "industrial control systems security", "ics security",
    "ot security", "ot cybersecurity",
]
LEX_TYPES = [
    "event", "conference", "meetup", "workshop", "webinar", "summit", "training", "seminar", "networking", "community event", "community meetup",
    "talk", "session", "roundtable", "masterclass", "bootcamp", "hackathon", "ctf", "capture the flag", "challenge",
]
LEX_ONLINE = [
    "online", "virtual", "remote", "webinar", "virtual event", "online event", "online meetup", "virtual meetup", "zoom", "teams", "google meet",
]
LEX_REGISTRATION = [
    "register", "registration", "rsvp", "ticket", "tickets", "book now", "sign up", "signup", "join event", "attend", "reserve", "apply now",
]
LEX_FREE = ["free", "free event", "no cost", "complimentary"]
LEX_PAID = ["paid", "ticket", "tickets", "₹", "rs.", "inr", "usd", "$"]
LEX_TRUST = {
    "owasp.org": 30, "null.community": 30, "securitybsides.com": 30, "meetup.com": 20, "eventbrite.com": 20, "lu.ma": 20, "luma.com": 20,
    "github.com": 15, "linkedin.com": 15,
}

STRONG_TOPICS = [
    "cybersecurity", "cyber security", "information security", "infosec", "application security", "appsec", "cloud security", "network security",
    "security operations", "soc", "incident response", "threat intelligence", "digital forensics", "penetration testing", "pentesting",
    "ethical hacking", "vulnerability", "vulnerabilities", "vapt", "red team", "blue team", "purple team", "zero trust",
    "identity and access management", "devsecops", "security engineering", "security architecture", "security conference", "security summit",
    "security webinar", "data security", "owasp", "ciso", "ransomware", "malware", "threat hunting", "secure coding", "software security",
    "secure software", "api security", "web security", "mobile security", "endpoint security", "cyber risk", "security testing", "grc", "bug bounty",
    "exploit development", "security research", "application security testing",
]
BROAD_TOPICS = [*STRONG_TOPICS, *["security operation", "forensics", "iam", "digital identity", "security awareness", "security compliance"]]
EVENT_WORDS = [
    "event", "conference", "summit", "webinar", "workshop", "meetup", "seminar", "symposium", "bootcamp", "training", "hackathon", "expo", "forum",
    "roundtable", "masterclass", "congress", "conclave", "competition", "session", "talk", "discussion", "fireside", "panel", "presentation",
    "keynote", "job fair",
]
INDIA_REGIONS = [
    "india", "indian", "telangana", "karnataka", "tamil nadu", "maharashtra", "kerala", "andhra pradesh", "uttar pradesh", "west bengal",
    "rajasthan", "gujarat", "odisha", "haryana", "punjab", "delhi ncr",
]
INDIA_CITIES = [
    "hyderabad", "secunderabad", "bangalore", "bengaluru", "chennai", "mumbai", "pune", "delhi", "new delhi", "gurgaon", "gurugram", "noida",
    "kolkata", "ahmedabad", "jaipur", "kochi", "coimbatore", "lucknow", "chandigarh", "indore", "bhubaneswar", "visakhapatnam", "vijayawada",
    "thiruvananthapuram",
]
INDIA_TERMS = [*INDIA_REGIONS, *INDIA_CITIES]
OTHER_COUNTRIES = [
    "united states", "united states of america", "usa", "u.s.a.", "u.s.", "canada", "united kingdom", "u.k.", "uk", "australia", "new zealand",
    "germany", "france", "spain", "italy", "singapore", "japan", "china", "south korea", "korea", "ireland", "netherlands", "switzerland", "sweden",
    "norway", "denmark", "finland", "belgium", "israel", "uae", "united arab emirates", "dubai", "qatar", "saudi arabia", "mexico", "mexico city",
    "brazil", "argentina", "colombia", "south africa", "egypt", "philippines", "indonesia", "malaysia", "thailand", "vietnam", "taiwan", "poland",
    "portugal", "austria", "czech republic", "czechia", "romania", "turkey",
]
ONLINE_WORDS = [
    "online", "virtual", "webinar", "remote", "online event", "virtual event", "online conference", "virtual conference", "online webinar",
    "online meetup", "virtual meetup", "livestream", "live stream", "zoom", "google meet", "microsoft teams", "teams meeting", "virtual session",
    "online session",
]
HYBRID_WORDS = [
    "hybrid", "online and in-person", "online & in-person", "virtual and in-person", "virtual & in-person", "in-person and online",
    "in person and online",
]
LISTING_PHRASES = [
    "all events", "upcoming events", "events calendar", "event calendar", "events listing", "event listings", "browse events", "find events",
    "search events", "global events", "regional events", "events directory", "event directory", "events page", "events archive", "event archive",
    "all upcoming events", "view all events", "see all events", "past events", "previous events", "event categories", "events by category",
    "event discovery", "discover events", "partner events", "appsec days events",
]
GENERIC_NAMES = [
    "global events", "regional events", "all events", "upcoming events", "events", "events calendar", "event calendar", "partner events",
    "appsec days events",
]
PAGE_TYPES = [
    "webinar", "conference", "summit", "workshop", "meetup", "seminar", "symposium", "hackathon", "training", "bootcamp", "expo", "forum",
    "roundtable", "masterclass", "congress", "conclave", "session", "talk", "panel", "keynote",
]
BARE_CURRENCIES = ["rs", "inr", "usd", "eur", "gbp", "$", "₹", "€", "£"]
REGISTER_LABELS = [
    "register", "registration", "tickets", "rsvp", "sign up", "book now", "attend", "join event", "get tickets", "reserve",
]
NULL_WORDS = ["none", "null", "n/a", "na", "not available", "not specified", "not found"]


def longest_first(terms: Iterable[str]) -> list[str]:
    """By falling length, then by code point, so that a pick never depends on a set's order."""
    return sorted(terms, key=lambda t: (-len(t), t))


def folded(terms: Iterable[str]) -> str:
    return "|".join(re.sub(r"([.^$*+?()\[\]{}|\\&-])", r"\\\1", t.lower()) for t in terms)


def branched(terms: Iterable[str]) -> str:
    """``folded`` with common beginnings written once: a text's place is held against each first letter, not each term.
    It tells whether a term matches; which one, where several do, it leaves open."""
    by: dict[str, list[str]] = {}
    words = sorted({t.lower() for t in terms})
    for t in words:
        if t:
            by.setdefault(t[0], []).append(t[1:])
    branches = "|".join(folded([c]) + branched(rest) for c, rest in by.items())
    return branches if len(by) < 2 and "" not in words else f"(?:{branches})" + "?" * ("" in words) if by else ""


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """Whether any term is a substring of the lower-cased text; a null text is empty."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(branched(terms))


def has_word(text: Column, terms: Iterable[str]) -> Column:
    """Whether any term stands between word boundaries of the normalised text."""
    return text.rlike(rf"(?U)\b{branched(terms)}\b")


def first_within(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """The value of the first term, in order, that is a substring; null if none. The text is computed once, and the list
    is one literal, however long."""
    known = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(v).alias("value")) for t, v in pairs])
    return let(text, lambda t: F.get(F.filter(known, lambda p: F.contains(t, p["term"])), F.lit(0))["value"])


def first_word(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """The value of the first term, in order, that stands between word boundaries; null if none. Most texts hold none of
    the terms, which one folded pattern tells."""
    pairs = list(pairs)
    return let(text, lambda t: F.when(has_word(t, [x for x, _ in pairs]), F.coalesce(*[F.when(has_word(t, [x]), F.lit(v)) for x, v in pairs])))


def found(text: Column, terms: Iterable[str]) -> Column:
    """The terms that are substrings of the lower-cased text, sorted."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(t) for t in sorted(terms)]), lambda t: F.contains(low, t))
