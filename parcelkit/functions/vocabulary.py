"""The vocabulary of classes: groups by prefix of LAYER.CLASS, and labels by LAYER.CLASS. Operators take both as tables, so that a file read by load_vocabulary may stand in for them."""

# Prefixes with a group of their own, and the listed classes.
CLASS_GROUPS = {
    "PARC.P": "main",
    "RESE.U": "main",
    "ZAST.ZU": "main",
    "REZV.R": "main",
    "ZMEN.Z": "main",
    "ZMEN.T": "main",
    "PODM.": "PODM / REGU",
    "REGU.": "PODM / REGU",
    "CUST.": "CUSTOM -> Set REF (create multiple by using different REF values)",
    "RZVP.B": "B - Bydlení",
    "RZVP.S": "S - Smíšené Obytné",
    "RZVP.R": "R - Rekreace",
    "RZVP.Z": "Z - Zeleň",
    "RZVP.O": "O - Občanské Vybavení",
    "RZVP.V": "V - Výroba A Skladování",
    "RZVP.H": "H - Smíšené Výrobní",
    "RZVP.A": "A - Zemědělské",
    "RZVP.D": "D - Dopravní Infrastruktura",
    "RZVP.T": "T - Technická Infrastruktura",
    "RZVP.P": "P - Veřejná Prostranství",
    "RZVP.W": "W - Vodní A Vodohospodářské",
    "RZVP.L": "L - Lesní",
    "RZVP.N": "N - Přírodní",
    "RZVP.MO": "Q - Městských Sídel",
    "RZVP.MR": "Q - Městských Sídel",
    "RZVP.MP": "Q - Městských Sídel",
    "RZVP.M": "M - Smíšené Krajinné",
    "RZVP.G": "G - Těžba",
    "RZVP.X": "X - Specifické",
    "RZVP.K": "K - Volné Krajiny Městských Sídel",
    "ZMEN.K": "OTHER",
}
CLASS_LABELS = {
    "PARC.P": "PARC.P - Parcely",
    "RESE.U": "RESE.U - řešené Území",
    "ZAST.ZU": "ZAST.ZU - Zastavěné Území",
    "REZV.R": "REZV.R - územní Rezerva",
    "ZMEN.Z": "ZMEN.Z - Zastavitelná plocha",
    "ZMEN.T": "ZMEN.T - Transformační plocha",
    "REGU.RP": "REGU.RP - území s prvky Regulačního Plánu",
    "PODM.US": "PODM.US - podmínka zpracování Územní Studie",
    "PODM.PS": "PODM.PS - podmínka uzavření Plánovací Smlouvy",
    "PODM.AU": "PODM.AU - podmínka realizace Architektonické nebo Urbanistické soutěže",
    "PODM.RP": "PODM.RP - podmínka vydání Regulačního Plánu",
    "PODM.X-DO": "PODM.X.DO - plocha s podmínkou dohody o parcelaci (LEGACY)",
    "CUST.X": "CUST.X - Custom - see @REF",
    "RZVP.AU": "AU - zemědělské všeobecné",
    "RZVP.AL": "AL - trvalé travní porosty",
    "RZVP.AT": "AT - trvalé kultury",
    "RZVP.AP": "AP - orná půda",
    "RZVP.AX": "AX - zemědělské jiné",
    "RZVP.BU": "BU - bydlení všeobecné",
    "RZVP.BI": "BI - bydlení individuální",
    "RZVP.BV": "BV - bydlení venkovské",
    "RZVP.BH": "BH - bydlení hromadné",
    "RZVP.BX": "BX - bydlení jiné",
    "RZVP.DS": "DS - doprava silniční",
    "RZVP.DU": "DU - doprava všeobecná",
    "RZVP.DD": "DD - doprava drážní",
    "RZVP.DK": "DK - doprava kombinovaná",
    "RZVP.DL": "DL - doprava letecká",
    "RZVP.DN": "DN - doprava nemotorová",
    "RZVP.DV": "DV - doprava vodní",
    "RZVP.DX": "DX - doprava jiná",
    "RZVP.GD": "GD - těžba dobývání a úprava",
    "RZVP.GU": "GU - těžba všeobecná",
    "RZVP.GX": "GX - těžba jiná",
    "RZVP.GZ": "GZ - těžba stavby a zařízení",
    "RZVP.HU": "HU - smíšené výrobní všeobecné",
    "RZVP.HX": "HX - smíšené výrobní jiné",
    "RZVP.LU": "LU - lesní všeobecné",
    "RZVP.LU.h": "LU.h - lesní všeobecné(hospodářské)",
    "RZVP.LU.o": "LU.o - lesní všeobecné(ochranné)",
    "RZVP.LU.z": "LU.z - lesní všeobecné(zvláštního určení)",
    "RZVP.LX": "LX - lesní jiné",
    "RZVP.MO": "MO - městské obytné",
    "RZVP.MP": "MP - městské produkční",
    "RZVP.MR": "MR - městské rekreační",
    "RZVP.MU": "MU - smíšené krajinné všeobecné",
    "RZVP.MU.e": "MU.e - smíšené krajinné všeobecné(erozně ohrožené)",
    "RZVP.MU.k": "MU.k - smíšené krajinné všeobecné(kulturně-historické zájmy)",
    "RZVP.MU.l": "MU.l - smíšené krajinné všeobecné(lesnictví extenzivní)",
    "RZVP.MU.o": "MU.o - smíšené krajinné všeobecné(ochrana proti ohrožení území)",
    "RZVP.MU.p": "MU.p - smíšené krajinné všeobecné(přírodní priority)",
    "RZVP.MU.r": "MU.r - smíšené krajinné všeobecné(rekreace nepobytová)",
    "RZVP.MU.s": "MU.s - smíšené krajinné všeobecné(sportovní využití)",
    "RZVP.MU.w": "MU.w - smíšené krajinné všeobecné(vodohospodářské zájmy)",
    "RZVP.MU.z": "MU.z - smíšené krajinné všeobecné(zemědělství extenzivní)",
    "RZVP.MX": "MX - smíšené krajinné jiné",
    "RZVP.NN": "NN - volné krajiny přírodní",
    "RZVP.NP": "NP - volné krajiny produkční",
    "RZVP.NR": "NR - volné krajiny rekreační",
    "RZVP.NU": "NU - přírodní všeobecné",
    "RZVP.NX": "NX - přírodní jiné",
    "RZVP.OU": "OU - občanské vybavení všeobecné",
    "RZVP.OH": "OH - občanské vybavení hřbitovy",
    "RZVP.OK": "OK - občanské vybavení komerční",
    "RZVP.OL": "OL - občanské vybavení lázeňské",
    "RZVP.OS": "OS - občanské vybavení sport",
    "RZVP.OV": "OV - občanské vybavení veřejné",
    "RZVP.OV.k": "OV.k - občanské vybavení veřejné(kultura)",
    "RZVP.OV.n": "OV.n - občanské vybavení veřejné(náboženství)",
    "RZVP.OV.o": "OV.o - občanské vybavení veřejné(ochrana obyvatelstva)",
    "RZVP.OV.p": "OV.p - občanské vybavení veřejné(sociální služby a péče o rodinu)",
    "RZVP.OV.s": "OV.s - občanské vybavení veřejné(vzdělání a výchova)",
    "RZVP.OV.v": "OV.v - občanské vybavení veřejné(veřejná správa)",
    "RZVP.OV.z": "OV.z - občanské vybavení veřejné(zdravotní služby)",
    "RZVP.OX": "OX - občanské vybavení jiné",
    "RZVP.PU": "PU - veřejná prostranství všeobecná",
    "RZVP.PX": "PX - veřejná prostranství jiná",
    "RZVP.RU": "RU - rekreace všeobecná",
    "RZVP.RI": "RI - rekreace individuální",
    "RZVP.RH": "RH - rekreace hromadná",
    "RZVP.RO": "RO - rekreace na oddechových plochách",
    "RZVP.RX": "RX - rekreace jiná",
    "RZVP.RZ": "RZ - rekreace v zahrádkářských osadách",
    "RZVP.SU": "SU - smíšené obytné všeobecné",
    "RZVP.SV": "SV - smíšené obytné venkovské",
    "RZVP.SC": "SC - smíšené obytné centrální",
    "RZVP.SM": "SM - smíšené obytné městské",
    "RZVP.SX": "SX - smíšené obytné jiné",
    "RZVP.TU": "TU - technická infrastruktura všeobecná",
    "RZVP.TE": "TE - energetika",
    "RZVP.TO": "TO - nakládání s odpady",
    "RZVP.TS": "TS - elektronické komunikace",
    "RZVP.TW": "TW - vodní hospodářství",
    "RZVP.TX": "TX - technická infrastruktura jiná",
    "RZVP.VU": "VU - výroba všeobecná",
    "RZVP.VD": "VD - výroba drobná a služby",
    "RZVP.VL": "VL - výroba lehká",
    "RZVP.VS": "VS - skladování a logistika",
    "RZVP.VT": "VT - výroba těžká a energetika",
    "RZVP.VX": "VX - výroba a skladování jiné",
    "RZVP.VZ": "VZ - výroba zemědělská a lesnická",
    "RZVP.VE": "VE - výroba energie z obnovitelných zdrojů",
    "RZVP.WH": "WH - vodohospodářské",
    "RZVP.WT": "WT - vodní a vodních toků",
    "RZVP.WU": "WU - vodní a vodohospodářské všeobecné",
    "RZVP.WX": "WX - vodní a vodohospodářské jiné",
    "RZVP.XX": "XX - specifické jiné",
    "RZVP.XZ": "XZ - specifické zvláštního určení",
    "RZVP.ZU": "ZU - zeleň všeobecná",
    "RZVP.ZK": "ZK - zeleň krajinná",
    "RZVP.ZO": "ZO - zeleň ochranná a izolační",
    "RZVP.ZP": "ZP - zeleň parková a parkově upravená",
    "RZVP.ZS": "ZS - zeleň sídelní ostatní",
    "RZVP.ZX": "ZX - zeleň jiná",
    "RZVP.ZZ": "ZZ - zeleň zahradní a sadová",
    "ZMEN.K": "ZMEN.K - plocha změny v Krajině",
}
# End of fixed values.
