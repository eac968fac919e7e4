"""Inspected topics: what the top terms of unguided topics were found to speak of."""

from __future__ import annotations

#: Topics of a fit on sf0.1 (40 topics a language), each with the subject that its top terms were read as, and some of those
#: terms that speak of it alone (fixed values). Topics of parties, redactions and mixed matter were given no subject.
INSPECTED_TOPICS: tuple[tuple[str, str, str], ...] = (
    ("en", "agriculture", "vines vintage silage cows"),
    ("en", "agriculture", "orchard crop seed harvester dairy slurry"),
    ("en", "agriculture", "potatoes maize"),
    ("en", "education", "headteacher invigilator"),
    ("en", "education", "thesis tuition nursery scholarship school"),
    ("en", "energy", "turbines inverter megawatt"),
    ("en", "energy", "curtailment boiler interconnector fuel grid solar"),
    ("en", "finance", "loan debtor tranche trustees covenant"),
    ("en", "finance", "fund collateral bond prospectus repayment"),
    ("en", "finance", "arrears dividend mandate investment custodian credit"),
    ("en", "housing", "heating laundry stairwell balcony sublet rent"),
    ("en", "housing", "mould carpet wardrobe"),
    ("en", "housing", "damp inventory lintel"),
    ("en", "media", "viewers novel author presenter"),
    ("en", "media", "diary newsroom interview tape subtitle photograph"),
    ("en", "medicine", "nurse clot sprain swab surgeon"),
    ("en", "medicine", "clinic physiotherapy ultrasound triage virus sedative"),
    ("en", "medicine", "midwife cardiac insulin dosage"),
    ("en", "science", "mice spectra postdoc broth"),
    ("en", "science", "spectrometer fossil gene replication"),
    ("en", "science", "reagent telescope calibration"),
    ("en", "shipping", "pilot captain deck freighter charter vessel cargo lading"),
    ("en", "software", "script code login repository migration"),
    ("en", "software", "memory programmers"),
    ("en", "software", "server bookings"),
    ("en", "software", "module interface application"),
    ("en", "software", "scheduler threads refactoring password"),
    ("en", "software", "patch rollback hosted"),
    ("en", "sport", "striker championship whistle ligament medals"),
    ("en", "sport", "squad stadium training athlete coaching"),
    ("en", "transport", "carriages rucksack lorry jackknifed"),
    ("en", "transport", "tyre tread boarding train flight"),
    ("de", "agriculture", "saatgutpartie wintergerste milchquote herdenregister fruchtfolge"),
    ("de", "education", "kindergartenplatz stundenplan abschlussprüfung doktorarbeit"),
    ("de", "education", "lehrplan zulassungsliste"),
    ("de", "energy", "gasspeicher zählerablesung umspannwerk netzanschluss wärmenetz"),
    ("de", "finance", "kontokorrentkredit nachschusspflicht kontogebühren"),
    ("de", "finance", "anleiheprospekt zinstauschgeschäft wertpapierdepot"),
    ("de", "housing", "dachabdichtung mieterhöhung wohnungsübergabe"),
    ("de", "housing", "räumungsklage mietkaution"),
    ("de", "media", "filmrechte interviewband tantiemen"),
    ("de", "media", "sendeplatz leserbrief titelfoto"),
    ("de", "medicine", "ultraschallbild überweisung gewebebefund entlassungsbrief"),
    ("de", "medicine", "narkoseprotokoll wundinfektion"),
    ("de", "science", "kalibrierkurve begutachtung probenlagerung laborbuch kontrollgruppe"),
    ("de", "shipping", "konnossement chartermiete laderaumbesichtigung"),
    ("de", "shipping", "ballastwasserbuch liegeplatzzuweisung lukendeckel"),
    ("de", "software", "quelltextablage testabdeckung migrationsskript lizenzschlüssel"),
    ("de", "software", "anwendungsschnittstelle instanz"),
    ("de", "sport", "trainingslager nachwuchsakademie transferfenster"),
    ("de", "sport", "dopingprobe stadionverbot spielbericht"),
    ("de", "transport", "bahnübergang straßenbahndepot flugverspätung"),
    ("de", "transport", "parkplatz bahnhof mautrechnung bordkarte"),
    ("fr", "agriculture", "troupeau orge cultures lisier"),
    ("fr", "agriculture", "laitier pacage irrigation semences"),
    ("fr", "education", "crèche barème examen"),
    ("fr", "education", "scolaire études thèse"),
    ("fr", "energy", "énergie équilibrage compteur stockage"),
    ("fr", "energy", "réseau raccordement chaleur"),
    ("fr", "finance", "marge mandat remboursement découvert prospectus"),
    ("fr", "finance", "compte taux titres"),
    ("fr", "housing", "congé locataire mitoyen humidité"),
    ("fr", "housing", "toit étanchéité locatives"),
    ("fr", "media", "diffusion lecteurs redevances"),
    ("fr", "media", "éditoriale enregistrement photographie"),
    ("fr", "medicine", "échographie anesthésie posologie biopsie"),
    ("fr", "medicine", "postopératoire opération consentement"),
    ("fr", "science", "subvention échantillons laboratoire évaluation pairs"),
    ("fr", "science", "mesures brutes"),
    ("fr", "shipping", "surestaries connaissement bord"),
    ("fr", "shipping", "écoutille affrètement cales"),
    ("fr", "software", "code script migration licence"),
    ("fr", "software", "anomalies module applicative interface"),
    ("fr", "sport", "match stade entraînement"),
    ("fr", "sport", "antidopage transfert fédération discipline"),
    ("fr", "transport", "chronotachygraphe péage embarquement"),
    ("fr", "transport", "gare tramways correspondance"),
)

SUBJECTS = tuple(sorted({subject for _, subject, _ in INSPECTED_TOPICS}))


def inspected_terms(lang: str) -> dict[str, set[str]]:
    """The terms of each subject in a language."""
    out: dict[str, set[str]] = {s: set() for s in SUBJECTS}
    for of, subject, terms in INSPECTED_TOPICS:
        if of == lang:
            out[subject].update(terms.split())
    return out
