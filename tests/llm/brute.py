"""Brute-force values of the digests, from lists of (id, text)."""
import hashlib,re,struct,unicodedata,zlib
import numpy as np
import xxhash
from collections import Counter,defaultdict
W=re.compile(r'[^\x20\x09-\x0D]+')
sha=lambda s: hashlib.sha256(s.encode()).hexdigest()
def op7(d,t):
    t=t or ''
    w=W.findall(t); lines=[l for l in t.split('\n') if W.search(l)]
    seen=set(); dup=0
    for l in lines:
        dup+= l in seen; seen.add(l)
    g=[tuple(w[i:i+8]) for i in range(len(w)-7)]; c=Counter(g); cov=set()
    for i,x in enumerate(g):
        if c[x]>1: cov|=set(range(i,i+8))
    return dict(doc_id=d,n_words=len(w),word_chars=sum(map(len,w)),n_symbols=sum(ch in '#*$%&|<>' for ch in t),n_dup_lines=dup,n_repeat_words=len(cov),base_failed=len(w)<20 or 100*len(cov)>30*len(w))
A=re.compile(r"""(?:(?ai:(?:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
def op10(d,t):
    t=t or ''
    s=[(m.start(),0,'assign',m.end()) for m in A.finditer(t) if len(m[1])>=6]
    n1=len(s)
    s+=[(m.start(),1,'access',m.end()) for m in re.finditer('AKIA[A-Z0-9]+',t) if len(m[0])>=20]; n2=len(s)-n1
    s+=[(m.start(),2,'hex',m.end()) for m in re.finditer('[0-9a-f]+',t) if len(m[0])>=24]; n3=len(s)-n1-n2
    s.sort()
    return dict(doc_id=d,n_assign=n1,n_access=n2,n_hex=n3,base_sha256=sha(','.join(f'{k}:{a}:{b}' for a,_,k,b in s)))
def op4(docs,bench):
    pat=re.compile(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
    low=lambda s: re.sub('[A-Z]',lambda m:m[0].lower(),s or '')
    wins=defaultdict(set)
    for i,t in bench:
        w=pat.findall(low(t)); n=min(10,len(w))
        for j in range(len(w)-n+1 if n else 0): wins[tuple(w[j:j+n])].add(str(i))
    lens={len(x) for x in wins}; out=[]
    for d,t in docs:
        w=pat.findall(low(t)); hit=set(); items=set()
        for n in lens:
            for j in range(len(w)-n+1):
                if (k:=wins.get(tuple(w[j:j+n]))): hit|=set(range(j,j+n)); items|=k
        out.append(dict(doc_id=d,n_words=len(w),n_hit=len(hit),n_items=len(items),items_sha256=sha(','.join(sorted(items))),contaminated=bool(hit)))
    return out
def op2(docs):
    low=lambda s: re.sub('[A-Z]',lambda m:m[0].lower(),s or '')
    sets={}
    for d,t in docs:
        w=W.findall(low(t)); sets[d]=frozenset(tuple(w[i:i+5]) for i in range(max(1,len(w)-4))) if w else frozenset()
    inv=defaultdict(list)
    for d,s in sets.items():
        for g in s: inv[g].append(d)
    over=Counter()
    for l in inv.values():
        for i,a in enumerate(l):
            for b in l[i+1:]: over[a,b]+=1
    par={d:d for d in sets}
    def find(x):
        while par[x]!=x: par[x]=par[par[x]]; x=par[x]
        return x
    links=0
    for (a,b),o in over.items():
        if 100*o>=80*(len(sets[a])+len(sets[b])-o):
            links+=1; x,y=find(a),find(b); par[max(x,y)]=min(x,y)
    return [dict(doc_id=d,n_shingles=len(s),component_id=find(d)) for d,s in sets.items()]
def op9(docs):
    first={}; ws={d:W.findall(t or '') for d,t in docs}
    for d in sorted(ws):
        w=ws[d]
        for i in range(len(w)-49): first.setdefault(tuple(w[i:i+50]),d)
    out=[]
    for d,w in ws.items():
        cov=[False]*len(w)
        for i in range(len(w)-49):
            if first[tuple(w[i:i+50])]<d:
                cov[i:i+50]=[True]*50
        out.append(dict(doc_id=d,n_words=len(w),n_removed=sum(cov),kept_sha256=sha(' '.join(x for x,c in zip(w,cov) if not c))))
    return out
def op6(docs,n=200):
    cnt=Counter(); bs={d:(t or '').encode() for d,t in docs}
    for b in bs.values():
        for i in range(len(b)-n+1): cnt[hash(b[i:i+n])]+=1
    out=[]
    for d,b in bs.items():
        m=bytearray(len(b))
        for i in range(len(b)-n+1):
            if cnt[hash(b[i:i+n])]>1: m[i:i+n]=b'\1'*n
        kept=bytes(x for x,c in zip(b,m) if not c)
        spans=len(re.findall(b'\1+',bytes(m)))
        out.append(dict(doc_id=d,n_bytes=len(b),n_removed=sum(m),n_spans=spans,kept_sha256=hashlib.sha256(kept).hexdigest()))
    return out
def op8(pages):
    first={}
    for p,h in pages:
        h=(h or '').encode()
        if len(h)>=100: first[h]=min(first.get(h,p),p)
    out=[]
    for p,h in pages:
        h=(h or '').encode(); f=first.get(h); rev=f is not None and f!=p
        out.append(dict(page_id=p,payload_bytes=len(h),payload_digest=hashlib.sha256(h).hexdigest(),record_type='revisit' if rev else 'response',refers_to=f if rev else None))
    return out
def op3(docs,n=40,seed=42):
    """Shards by rendezvous hashing (one 64-bit hash chained through seed, shard and id), slots by a seeded shuffle; for texts that fit one bucket a shard."""
    def drawn(d,k):
        def h(i):
            v=42
            for x,f in ((seed,'<i'),(i,'<i'),(d,'<q')): v=xxhash.xxh64_intdigest(struct.pack(f,x),v)
            return v-(1<<64) if v>>63 else v
        return max(range(k),key=lambda i:(h(i),i))
    out=[dict(doc_id=d,size=len((t or '').encode())+16,text_crc32=zlib.crc32((t or '').encode()),law='key',shard=drawn(d,n),grown_shard=drawn(d,n+1)) for d,t in docs]
    for s in range(n):
        rows=sorted((r for r in out if r['shard']==s),key=lambda r:(r['doc_id'],r['text_crc32'],r['size']))
        order=np.arange(len(rows)); np.random.Generator(np.random.PCG64([seed,s])).shuffle(order)
        for slot,i in enumerate(order): rows[i]['slot']=slot
    return out
def op7_kept(d,t,rules):
    """The verdict of an ordered list of rules, from features that are counted here anew."""
    t=t or ''; b=op7(d,t); w=W.findall(t); lines=[l for l in t.split('\n') if W.search(l)]
    n,c,k=max(1,len(w)),max(1,b['word_chars']),max(1,len(lines))
    f=dict(n_words=len(w),mean_word=b['word_chars']/n,symbol_share=b['n_symbols']/n,dup_line_share=b['n_dup_lines']/k,repeat_share=b['n_repeat_words']/n,
           upper_share=sum(unicodedata.category(x)=='Lu' for x in t)/c,digit_share=sum(x in '0123456789' for x in t)/c,mark_share=sum(x in '!?:;=+@^~' for x in t)/n,
           distinct_share=len(set(w))/n,words_a_line=len(w)/k)
    bad=any(all(f[a]<=x if o=='<=' else f[a]>x for a,o,x in r) for r in rules)
    return not b['base_failed'] and not bad
