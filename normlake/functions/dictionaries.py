"""Law-code dictionaries. What a code means is a fact that results depend on, so they stand here as plain text, a line for each entry."""

from __future__ import annotations

# Code key | slug (empty: known not to be a law).
SLUG_ALIASES = """
g10|g10_2001
gg|gg
bdsg|bdsg_2018
stvo|stvo_2013
jveg|jveg
egbgb|bgbeg
egzpo|zpoeg
egstgb|stgbeg
egstpo|stpoeg
eggvg|gvgeg
eghgb|hgbeg
bürgerlichesgesetzbuch|bgb
zivilprozessordnung|zpo
strafgesetzbuch|stgb
handelsgesetzbuch|hgb
grundgesetz|gg
arzneimittelgesetz|amg_1976
kunsturhebergesetz|kunsturhg
zahlungskontengesetz|zkg
betriebsverfassungsgesetz|betrvg
produkthaftungsgesetz|prodhaftg
pflichtversicherungsgesetz|pflvg
urheberrechtsgesetz|urhg
markengesetz|markeng
patentgesetz|patg
kündigungsschutzgesetz|kschg
bundesurlaubsgesetz|burlg
entgeltfortzahlungsgesetz|entgfg
arbeitszeitgesetz|arbzg
jugendschutzgesetz|juschg
straßenverkehrsgesetz|stvg
versicherungsvertragsgesetz|vvg_2008
telekommunikationsgesetz|tkg_2021
weg|woeigg
wohnungseigentumsgesetz|woeigg
baugb|bbaug
baugesetzbuch|bbaug
haftpflichtg|haftpflg
haftpflichtgesetz|haftpflg
atomg|atg
atomgesetz|atg
efzg|entgfg
erbbaurg|erbbauv
nachweisgesetz|nachwg
wirtschaftsstrafgesetz|wistrg_1954
jugendarbeitsschutzg|jarbschg
jugendarbeitsschutzgesetz|jarbschg
umwelthaftungsgesetz|umwelthg
wasserhaushaltsgesetz|whg_2009
whg|whg_2009
gentechnikgesetz|gentg
mutterschutzgesetz|muschg_2018
muschg|muschg_2018
sgbi|sgb_1
sgbii|sgb_2
sgbiii|sgb_3
sgbiv|sgb_4
sgbv|sgb_5
sgbvi|sgb_6
sgbvii|sgb_7
sgbviii|sgb_8
sgbix|sgb_9_2018
sgbx|sgb_10
sgbxi|sgb_11
sgbxii|sgb_12
sgbxiv|sgb_14
handwo|hwo
handwerksordnung|hwo
kwg|kredwg
erbbrvo|erbbauv
markg|markeng
egfzg|entgfg
energiewirtschaftsg|enwg_2005
energiewirtschaftsgesetz|enwg_2005
personenbeförderungsg|pbefg
personenbeförderungsgesetz|pbefg
ladenschlussg|ladschlg
ladenschlussgesetz|ladschlg
versammlungsgesetz|versammlg
verwaltungsgerichtsordnung|vwgo
wovermittg|wovermrg
verordnung|
bundesimmissionsschutzgesetz|bimschg
gewerbeordnung|gewo
verwaltungsverfahrensgesetz|vwvfg
gaststättengesetz|gastg
einkommensteuergesetz|estg
einkommenssteuergesetz|estg
handwerkso|hwo
tarifvertragsgesetz|tvg
außenwirtschaftsgesetz|awg_2013
bundesfernstraßengesetz|fstrg
rechtsdienstleistungsgesetz|rdg
depotg|wpapg
wistg|wistrg_1954
wistrg|wistrg_1954
mabv|gewo_34cdv
kug|kunsturhg
steuerberg|stberg
gmbhgesetz|gmbhg
patentg|patg
mutterschutzg|muschg_2018
bundesurlaubsg|burlg
entgeltfortzahlungsg|entgfg
entgeltfg|entgfg
kündschg|kschg
kuendschg|kschg
azg|arbzg
nachweisg|nachwg
aueg|a_g
versteigerungsg|zvg
grundbucho|gbo
gerichtsverfassungsg|gvg
woeigg|woeigg
woeigentumsg|woeigg
wohnungseigentumsg|woeigg
wipro|wipro
hpflg|haftpflg
versg|versammlg
wechselg|wg
bbaug|bbaug
aktieng|aktg
genossenschaftsg|geng
prodhg|prodhaftg
pflversg|pflvg
gaststätteng|gastg
insolvenzo|inso
asylvfg|asylvfg_1992
umwandlungsg|umwg_1995
reichsversicherungso|rvo
arbgerg|arbgg
urheberg|urhg
betrverfg|betrvg
publizitätsg|publg
beurkundungsg|beurkg
"""

# Journals, courts, reporters and apparatus words that look like codes.
REJECTED = """
NJW
NJW-RR
JuS
JZ
MDR
ZZP
ZIP
WM
BB
DB
NZG
NZI
NZA
NVwZ
NStZ
GRUR
VersR
WuM
ZEV
ZfPW
AcP
JR
JA
Jura
ZGR
ZHR
BGHZ
BGHSt
BVerfGE
BVerwGE
BAGE
BSGE
BFHE
RGZ
RGSt
BGH
BVerfG
BVerwG
BAG
BSG
BFH
OLG
KG
LG
AG
VG
OVG
VGH
EuGH
EGMR
RG
Rn
Rdnr
Rz
Rnr
BGBl
BAnz
ABl
Aufl
Bd
Hrsg
Fn
Anm
Vorb
Vor
Einl
Ed
BT-Drs
BT-Drucks
BR-Drs
BR-Drucks
VO
RL
UA
TOA
"""

# Code | name | aliases.
EU_LAWS = """
DSGVO|Datenschutz-Grundverordnung|GDPR|RGPD|VO (EU) 2016/679|Verordnung (EU) 2016/679
AEUV|Vertrag über die Arbeitsweise der Europäischen Union|AEU-Vertrag
EUV|Vertrag über die Europäische Union|EU-Vertrag
GRCh|Charta der Grundrechte der Europäischen Union|GRC|EGRC|EU-Grundrechtecharta
EGV|EG-Vertrag (historisch, heute AEUV)|EG|EG-Vertrag|EWGV|EWG-Vertrag
EMRK|Europäische Menschenrechtskonvention
CISG|UN-Kaufrecht
Brüssel-Ia-VO|Verordnung (EU) Nr. 1215/2012 (EuGVVO)|EuGVVO|Brüssel Ia-Verordnung|BrüsselIa-Verordnung|VO (EU) 1215/2012|VO (EU) Nr. 1215/2012|Verordnung (EU) Nr. 1215/2012
Brüssel-IIa-VO|Verordnung (EG) Nr. 2201/2003|Brüssel IIa-Verordnung|BrüsselIIa-Verordnung|VO (EG) 2201/2003|VO (EG) Nr. 2201/2003
Rom-I-VO|Verordnung (EG) Nr. 593/2008|Rom I|RomI|RomI-VO|Rom-I-Verordnung|VO (EG) 593/2008|VO (EG) Nr. 593/2008
Rom-II-VO|Verordnung (EG) Nr. 864/2007|Rom II|RomII|RomII-VO|Rom-II-Verordnung|VO (EG) 864/2007|VO (EG) Nr. 864/2007
Rom-III-VO|Verordnung (EU) Nr. 1259/2010|Rom III|RomIII|RomIII-VO|Rom-III-Verordnung|VO (EU) 1259/2010|VO (EU) Nr. 1259/2010
EuErbVO|Verordnung (EU) Nr. 650/2012|EU-ErbVO|EUErbVO|EU-ErbrechtsVO|VO (EU) 650/2012|VO (EU) Nr. 650/2012
EuInsVO|Verordnung (EU) 2015/848|EU-InsVO|VO (EU) 2015/848|VO (EU) Nr. 2015/848
EuMahnVO|Verordnung (EG) Nr. 1896/2006|EU-MahnVO|EuMahnverfVO|VO (EG) 1896/2006|VO (EG) Nr. 1896/2006
EuUnterhaltsVO|Verordnung (EG) Nr. 4/2009|EU-UnterhaltsVO|VO (EG) 4/2009|VO (EG) Nr. 4/2009
EuVTVO|Verordnung (EG) Nr. 805/2004|EU-VTVO|EU-VollstreckungstitelVO|VO (EG) 805/2004|VO (EG) Nr. 805/2004
EuGFVO|Verordnung (EG) Nr. 861/2007|EU-BagatellVO|EuBagatellVO|VO (EG) 861/2007|VO (EG) Nr. 861/2007
MAR|Marktmissbrauchsverordnung (EU) Nr. 596/2014|MMVO|VO (EU) 596/2014|VO (EU) Nr. 596/2014
MiFIR|Verordnung (EU) Nr. 600/2014|MiFiR|VO (EU) 600/2014|VO (EU) Nr. 600/2014
MiFID II|Richtlinie 2014/65/EU|MiFIDII|MiFiDII|MiFID|MiFiD|Finanzmarktrichtlinie|RL 2014/65/EU
ProspektVO|Verordnung (EU) 2017/1129|EU-Prospekt-Verordnung|VO (EU) 2017/1129|VO (EU) Nr. 2017/1129
PRIIP-VO|Verordnung (EU) Nr. 1286/2014|PRIIPVO|PRIIP-Verordnung
Taxonomie-VO|Verordnung (EU) 2020/852|TaxonomieVO|VO (EU) 2020/852|VO (EU) Nr. 2020/852
SDÜ|Schengener Durchführungsübereinkommen|SchengenerDFÜ|SchengenerDVÜ
Warenkauf-RL|Richtlinie (EU) 2019/771|WKRL|RL (EU) 2019/771
Verbraucherrechte-RL|Richtlinie 2011/83/EU|VRRL|RL 2011/83/EU
Reparatur-RL|Richtlinie (EU) 2024/1799|RL (EU) 2024/1799
GPSR|Produktsicherheitsverordnung (EU) 2023/988|VO (EU) 2023/988
GEKR-VO|Vorschlag Gemeinsames Europäisches Kaufrecht|GEKR
"""

# Cited works that are no federal statutes | kind.
WORKS = """
VOB|Klauselwerk
VOB/A|Klauselwerk
VOB/B|Klauselwerk
VOB/C|Klauselwerk
VOL/A|Klauselwerk
VOL/B|Klauselwerk
VOF|Klauselwerk
BAT|Tarifvertrag
TVöD|Tarifvertrag
TV-L|Tarifvertrag
AGB-Banken|Klauselwerk
AGB-Sparkassen|Klauselwerk
ADSp|Klauselwerk
DCGK|Klauselwerk
EuGH-Satzung|Satzung
BORA|Satzung
FAO|Satzung
MBO-Ä|Satzung
CIC|Kirchenrecht
RStV|Staatsvertrag
MStV|Staatsvertrag
JMStV|Staatsvertrag
GlüStV|Staatsvertrag
LottStV|Staatsvertrag
RBStV|Staatsvertrag
MDStV|Staatsvertrag
GeschOEP|Geschäftsordnung
GeschORat|Geschäftsordnung
GeschOKom|Geschäftsordnung
EuGH-VerfO|Verfahrensordnung
LVwVfG|Landesrecht
BayVwVfG|Landesrecht
BayGO|Landesrecht
ASOG|Landesrecht
"""

# Repealed laws | name | date of repeal | successor.
REPEALED = """
AGBG|AGB-Gesetz|2002-01-01|§§ 305–310 BGB; UKlaG
AGB-Gesetz|AGB-Gesetz|2002-01-01|§§ 305–310 BGB; UKlaG
VerbrKrG|Verbraucherkreditgesetz|2002-01-01|§§ 491 ff. BGB
HWiG|Haustürwiderrufsgesetz|2002-01-01|heute §§ 312b ff. BGB
HaustürWG|Haustürwiderrufsgesetz|2002-01-01|heute §§ 312b ff. BGB
FernAbsG|Fernabsatzgesetz|2002-01-01|heute §§ 312c ff. BGB
BGB-InfoV|BGB-Informationspflichten-Verordnung|2018-07-01|Art. 246 ff. EGBGB
AbzG|Abzahlungsgesetz|1991-01-01|heute §§ 491 ff., 506 ff. BGB
TDG|Teledienstegesetz|2007-03-01|TMG; heute DDG
TDDSG|Teledienstedatenschutzgesetz|2007-03-01|heute TDDDG
TMG|Telemediengesetz|2024-05-14|DDG; Datenschutz im TDDDG
IuKDG|Informations- und Kommunikationsdienste-Gesetz|2007-03-01|heute DDG/TDDDG
SigG|Signaturgesetz|2017-07-29|eIDAS-VO und VDG
TDSV|Telekommunikations-Datenschutzverordnung|2004-06-26|heute TDDDG
TKV|Telekommunikations-Kundenschutzverordnung|2007-02-24|§§ 43a ff. TKG
FGG|Gesetz über die Angelegenheiten der freiwilligen Gerichtsbarkeit|2009-09-01|FamFG
KO|Konkursordnung|1999-01-01|InsO
VerglO|Vergleichsordnung|1999-01-01|InsO
GesO|Gesamtvollstreckungsordnung|1999-01-01|InsO
RabattG|Rabattgesetz|2001-07-25|ersatzlos; Grenzen im UWG
ZugabeVO|Zugabeverordnung|2001-07-25|ersatzlos; Grenzen im UWG
LohnFG|Lohnfortzahlungsgesetz|2006-01-01|EntgFG
LFZG|Lohnfortzahlungsgesetz|2006-01-01|EntgFG
SchwbG|Schwerbehindertengesetz|2001-07-01|SGB IX
AZO|Arbeitszeitordnung|1994-07-01|ArbZG
BeschFG|Beschäftigungsförderungsgesetz|2001-01-01|TzBfG
AFG|Arbeitsförderungsgesetz|1998-01-01|SGB III
BSHG|Bundessozialhilfegesetz|2005-01-01|SGB XII
ADHGB|Allgemeines Deutsches Handelsgesetzbuch|1900-01-01|HGB
EheG|Ehegesetz|1998-07-01|§§ 1303 ff. BGB
MHG|Miethöhegesetz|2001-09-01|§§ 557 ff. BGB
BRAGO|Bundesgebührenordnung für Rechtsanwälte|2004-07-01|RVG
KostO|Kostenordnung|2013-08-01|GNotKG
ZSEG|Zeugen- und Sachverständigenentschädigungsgesetz|2004-07-01|JVEG
JÖSchG|Gesetz zum Schutze der Jugend in der Öffentlichkeit|2003-04-01|JuSchG
GjS|Gesetz über die Verbreitung jugendgefährdender Schriften|2003-04-01|JuSchG
GjSM|GjS und Medieninhalte|2003-04-01|JuSchG
BErzGG|Bundeserziehungsgeldgesetz|2008-12-31|BEEG
MPG|Medizinproduktegesetz|2021-05-26|MPDG und EU-MDR
BRRG|Beamtenrechtsrahmengesetz|2009-04-01|BeamtStG
StHG|Staatshaftungsgesetz 1981|1982-10-19|nichtig (BVerfGE 61, 149); § 839 BGB iVm Art. 34 GG
AuslG|Ausländergesetz|2005-01-01|AufenthG
RBerG|Rechtsberatungsgesetz|2008-07-01|RDG
HausratsVO|Hausratsverordnung|2009-09-01|§§ 1568a f. BGB; §§ 200 ff. FamFG
WZG|Warenzeichengesetz|1995-01-01|MarkenG
GeschmMG|Geschmacksmustergesetz|2014-01-01|DesignG
GSG|Gerätesicherheitsgesetz|2004-05-01|heute ProdSG
GPSG|Geräte- und Produktsicherheitsgesetz|2011-12-01|ProdSG
MRRG|Melderechtsrahmengesetz|2015-11-01|BMG
"""

# Common codes, for use without a list of slugs.
FALLBACK = """
BGB
StGB
ZPO
StPO
GG
HGB
AktG
GmbHG
InsO
EStG
AO
VwGO
VwVfG
SGB
UWG
UrhG
MarkenG
PatG
BImSchG
KrWG
WHG
EGBGB
FamFG
GVG
ArbGG
KSchG
TVG
BetrVG
WEG
ErbbauRG
StVG
StVO
StVZO
PflVG
ProdHaftG
VVG
TKG
BDSG
IfSG
OWiG
"""


def rows(table: str) -> list[list[str]]:
    """The lines of one of the tables above, cut at bars."""
    return [line.split("|") for line in table.strip().splitlines()]
