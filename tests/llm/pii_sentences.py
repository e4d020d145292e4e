"""Sentences written and labelled by hand, none made by the trees' own generator: (text, personal data beyond the base patterns)."""

SENTENCES = [
    ("You can reach me at maria.lopez [at] uni-bonn.de after the seminar.", ["maria.lopez [at] uni-bonn.de"]),
    ("Send the draft to k_olsen(at)fjord.no before noon, please.", ["k_olsen(at)fjord.no"]),
    ("Fragen bitte an hans.meier {at} stadtwerke {dot} de richten.", ["hans.meier {at} stadtwerke {dot} de"]),
    ("contact: bob [AT] example [DOT] com (no spam)", ["bob [AT] example [DOT] com"]),
    ("My address is jill.b at gmail dot com, write any time.", ["jill.b at gmail dot com"]),
    ("Pour plus d'informations : c.durand[at]mairie-lyon.fr ou sur place.", ["c.durand[at]mairie-lyon.fr"]),
    ("Editor's mail: letters＠paper.co.uk, all others go to the desk.", ["letters＠paper.co.uk"]),
    ("Call our office on (212) 555-0187 between nine and five.", ["(212) 555-0187"]),
    ("Telefon 030 901820, Mo bis Fr.", ["030 901820"]),
    ("Tel. 089/2180-1234 (Sekretariat)", ["089/2180-1234"]),
    ("Mi movil es 612 345 678, llamame cuando puedas.", ["612 345 678"]),
    ("Appelez le 01 42 68 53 00 pour un rendez-vous.", ["01 42 68 53 00"]),
    ("text me 415-555-2671 when you land", ["415-555-2671"]),
    ("Fax: 0221.4710.88, att. Frau Krause", ["0221.4710.88"]),
    ("my cell is 5105550123 if you get lost", ["5105550123"]),
    ("WhatsApp 07700 900123 for bookings", ["07700 900123"]),
    ("the front desk, phone 617.555.0144, will let you in", ["617.555.0144"]),
    ("Ruf mich an: 0171/3456789", ["0171/3456789"]),
    ("charged to card 4539.1488.0343.6467 last night", ["4539.1488.0343.6467"]),
    ("Visa 4716 / 1088 / 9971 / 6530 void", []),
    ("Karte 5555_5555_5555_4444 gesperrt", ["5555_5555_5555_4444"]),
    ("credit card: 3782.822463.10005", ["3782.822463.10005"]),
    ("The server answers on 2001:0db8:85a3:0000:0000:8a2e:0370:7334 only.", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"]),
    ("login from host fe80::1ff:fe23:4567:890a refused", ["fe80::1ff:fe23:4567:890a"]),
    ("blocked ip 203[.]0[.]113[.]45 after ten tries", ["203[.]0[.]113[.]45"]),
    ("beacon to 198(.)51(.)100(.)7 seen twice", ["198(.)51(.)100(.)7"]),
    ("The meeting on 2019-03-14 was moved to 21.03.2019.", []),
    ("See pages 1204-1299 and figures 12.334 to 18.221.", []),
    ("Invoice 2023-000451-77 is overdue.", []),
    ("Version 10.15.7 build 19207 fixes it.", []),
    ("ISBN 978-3-16-148410 is out of print.", []),
    ("They met at noon in the hall [at] last.", []),
    ("The ratio was 12:45:33 on the clock.", []),
    ("Order 88213 90045 shipped on Monday.", []),
    ("Population rose from 1 204 330 to 1 310 002 in ten years.", []),
    ("Part no. 4021-77-10032 fits all models.", []),
    ("Artikelnummer 0815 4711 ist ausverkauft.", []),
    ("El presupuesto fue de 12 500 000 euros.", []),
    ("distances of 384 400 000 m and 149 597 870 km", []),
    ("serial 1234.5678.9012.3456 on the lid", []),
    ("Between 1914-1918 and 1939-1945 the mill stood still.", []),
    ("We sat at table dot and waited.", []),
    ("page 3 at the dot of noon, lot 220-14", []),
    ("the array [1] [2] {at} index 7", []),
    ("Score 110-98 and 102-87 in the finals of 2011/2012.", []),
    ("mac 00:1a:2b:3c:4d:5e bridged", []),
    ("MIDI track 01:02:03:04 starts late", []),
    ("temperatures -12.50 to 33.75 over 1990/2020", []),
]
