"""Layouts of the covariances of resonance parameters, and of multilevel (Adler) parameters.

The notation is that of :mod:`notation`, variable names those of the public format manual.
"""

from __future__ import annotations

from textwrap import indent


def _within(levels: int, text: str) -> str:
    return indent(text.strip("\n"), "    " * levels)


#: Multilevel parameters, with polynomials for the background of total, fission and capture.
MULTILEVEL = """
cont SPI AP 0 0 NLS 0
list AWRI 0 LI 0 6*NX NX
    for x = 1..NX
        vals A1[x] A2[x] A3[x] A4[x] B1[x] B2[x]
for n = 1..NLS
    section l_group[n]
        cont 0 0 L 0 NJS 0
        for j = 1..NJS
            section j_group[j]
                list AJ 0 0 0 12*NLJ NLJ
                    for r = 1..NLJ
                        vals DET[r] DWT[r] GRT[r] GIT[r]
                        vals DEF[r] DWF[r] GRF[r] GIF[r]
                        vals DEC[r] DWC[r] GRC[r] GIC[r]
"""
#: Any matrix of energies and values, as its list holds it.
_LISTED = """
list 0 0 {first} LB NT NE
    for q = 1..NT
        vals F[q]
"""
#: Variances and covariances within single resonances, as older libraries hold them.
_SINGLE = """
for n = 1..NLS
    section l_group[n]
        list AWRI 0 L 0 18*NRS NRS
            for r = 1..NRS
                vals ER[r] AJ[r] GT[r] GN[r] GG[r] GF[r]
                vals DE2[r] DN2[r] DNDG[r] DG2[r] DNDF[r] DGDF[r]
                vals DF2[r] DJDN[r] DJDG[r] DJDF[r] DJ2[r] 0
"""
#: The upper triangle of the matrix of all parameters of blocks of resonances.
_GENERAL = f"""
cont AWRI 0 0 0 NSRS NLRS
for n = 1..NSRS
    section short_range[n]
        list 0 0 MPAR 0 NVS NRB
            for r = 1..NRB
                vals ER[r] AJ[r] P1[r] P2[r] P3[r] P4[r]
            for p = 1..MPAR*NRB
                for q = p..MPAR*NRB
                    vals V[p,q]
for n = 1..NLRS
    section long_range[n]
{_within(2, _LISTED.format(first="IDP"))}
"""
#: Uncertainties, and correlations as packed whole numbers.
_COMPACT = """
if LRF == 1 or LRF == 2
    list AWRI QX 0 LRX 12*NRSA NRSA
        for r = 1..NRSA
            vals ER[r] AJ[r] GT[r] GN[r] GG[r] GF[r]
            vals DER[r] 0 0 DGN[r] DGG[r] DGF[r]
else
    list AWRI APL 0 0 12*NRSA NRSA
        for r = 1..NRSA
            vals ER[r] AJ[r] GN[r] GG[r] GFA[r] GFB[r]
            vals DER[r] 0 DGN[r] DGG[r] DGFA[r] DGFB[r]
cont 0 0 NDIGIT NNN NM 0
for m = 1..NM
    packed NDIGIT II[m] JJ[m] KIJ[m]
"""
RESONANCE_COVARIANCES = f"""
cont ZA AWR 0 0 NIS 0
for i = 1..NIS
    section isotope[i]
        cont ZAI ABN 0 LFW NER 0
        for k = 1..NER
            section range[k]
                cont EL EH LRU LRF NRO NAPS
                if NRO != 0
                    cont 0 0 0 0 0 NI
                    for m = 1..NI
                        section radius_part[m]
{_within(7, _LISTED.format(first="LS"))}
                if LRU == 1
                    if LRF == 7
                        stop covariances of this formalism are not covered
                    cont SPI AP 0 LCOMP NLS ISR
                    if ISR > 0
                        if LRF == 1 or LRF == 2
                            cont 0 DAP 0 0 0 0
                        else
                            list 0 0 0 0 MLS 1
                                for l = 1..MLS
                                    vals DAPL[l]
                    if LCOMP == 0
{_within(6, _SINGLE)}
                    elif LCOMP == 1
{_within(6, _GENERAL)}
                    else
{_within(6, _COMPACT)}
                else
                    cont SPI AP 0 0 NLS 0
                    for n = 1..NLS
                        section l_group[n]
                            list AWRI 0 L 0 6*NJS NJS
                                for j = 1..NJS
                                    vals D[j] AJ[j] GNO[j] GG[j] GF[j] GX[j]
                    list 0 0 MPAR 0 NT NPAR
                        for p = 1..NPAR
                            for q = p..NPAR
                                vals RV[p,q]
"""
