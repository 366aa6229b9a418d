"""Lines with personal details, each with what it holds, written after the patterns. At first sight 35 of the 44 details
were found, with one false; the patterns were mended since, so the set is no longer held out."""

LINES = [
    ("Hello, my name is Martha Ellwood and I need access.", [("person", "Martha Ellwood")]),
    ("The bug was triaged by Peter van Dalen last week", [("person", "Peter van Dalen")]),
    ("Jorge Salas-Pinto wrote the first draft of this parser.", [("person", "Jorge Salas-Pinto")]),
    ("According to Ingrid Holm the limit is arbitrary.", [("person", "Ingrid Holm")]),
    ("// courtesy of Anton Weber", [("person", "Anton Weber")]),
    ("Speak with Helen Carter before merging", [("person", "Helen Carter")]),
    ("Yours faithfully, Oliver Grant", [("person", "Oliver Grant")]),
    ("# patch sent in by Yuki Tanabe", [("person", "Yuki Tanabe")]),
    ("Professor Lena Fischer can be reached after lunch", [("person", "Lena Fischer")]),
    ("Lena K. Fischer explained the trick in class", [("person", "Lena K. Fischer")]),
    ("Regards, Samuel O'Connor", [("person", "Samuel O'Connor")]),
    ("Assignee: Chloe Martin", [("person", "Chloe Martin")]),
    ("Patient: Doyle, Francis", [("person", "Doyle, Francis")]),
    ("call Mary Poole on 0161 496 0123", [("person", "Mary Poole"), ("phone", "0161 496 0123")]),
    ("Questions go to sales@norwood.agency", [("email", "sales@norwood.agency")]),
    ("reply to amelia.k@startup.cloud please", [("email", "amelia.k@startup.cloud")]),
    ("<ben@harbour.studio>", [("email", "ben@harbour.studio")]),
    ("mail: j_doe99@uni-bonn.de", [("email", "j_doe99@uni-bonn.de")]),
    ("write to kim (at) lakeside (dot) org", [("email", "kim (at) lakeside (dot) org")]),
    ("her inbox, zoe+news@pine.photography, is full", [("email", "zoe+news@pine.photography")]),
    ("tel 5552345678", [("phone", "5552345678")]),
    ("Phone number is 2125550187.", [("phone", "2125550187")]),
    ("fax: +49 (0)30 901820", [("phone", "+49 (0)30 901820")]),
    ("ring me at (415) 555-0134", [("phone", "(415) 555-0134")]),
    ("mobile 415.555.0134", [("phone", "415.555.0134")]),
    ("whatsapp: +34 612 345 678", [("phone", "+34 612 345 678")]),
    ("dial 020 7946 0958 and wait", [("phone", "020 7946 0958")]),
    ("SSN: 219099999", [("id_number", "219099999")]),
    ("Social Security number is 219-09-9999", [("id_number", "219-09-9999")]),
    ("visa 4111111111111111 expired", [("id_number", "4111111111111111")]),
    ("amex card 378282246310005", [("id_number", "378282246310005")]),
    ("card 3782 822463 10005", [("id_number", "3782 822463 10005")]),
    ("DNI 12345678Z", [("id_number", "12345678Z")]),
    ("IBAN GB82 WEST 1234 5698 7654 32", [("id_number", "GB82 WEST 1234 5698 7654 32")]),
    ("passport no. AB1234567 was renewed", [("id_number", "AB1234567")]),
    ("ship to 12 Orchard Lane, Flat 3", [("address", "12 Orchard Lane, Flat 3")]),
    ("Hauptstr. 12 in the old town", [("address", "Hauptstr. 12")]),
    ("oficina: Calle Mayor 5", [("address", "Calle Mayor 5")]),
    ("parcel to P.O. Box 123", [("address", "P.O. Box 123")]),
    ("domicile: 14 rue des Lilas", [("address", "14 rue des Lilas")]),
    ("Lindenallee 7b is closed", [("address", "Lindenallee 7b")]),
    ("Via Roma 22 has parking", [("address", "Via Roma 22")]),
    ("deliver to 221B Baker Street", [("address", "221B Baker Street")]),
    ("x = a@b.T", []),
    ("@app.route('/index')", []),
    ("npm install left-pad@1.3.0", []),
    ("git clone git@code.example.org:team/tool.git", []),
    ("version 555-12-3456 of the schema", []),
    ("part 4111111111111112 is out of stock", []),
    ("card 4111111111111112 is mistyped", []),
    ("sha1 = 3782822463100059", []),
    ("SSN: 000123456", []),
    ("Thanks to Northwind Software Foundation", []),
    ("from Data Loader import Batch", []),
    ("see Section Two of the New York Times style", []),
    ("Please Note That This Table Is Sorted", []),
    ("Copyright (c) 2020 The Acme Project Authors", []),
    ("class Error Handler said nothing", []),
    ("call Main Loop twice", []),
    ("timeout 2125550187 ms", []),
    ("offset 12 Park", []),
    ("10 Downing was mentioned", []),
]
